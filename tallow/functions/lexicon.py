"""Word lists and findings as data. Patterns are matched against plain (lower-case, unmarked) text.

The columns' names are fixed values. The vocabularies of five report languages and the function words are this engine's own; other ones can be given to every operator.
"""

from __future__ import annotations

from dataclasses import dataclass, field

#: Where a clause ends: punctuation, or a contrasting conjunction.
CLAUSE_MARKS = r"[.;:\n\r]+|,"
CLAUSE_ENDS = CLAUSE_MARKS + r"|\b(?:but|however|pero|sin embargo|ancak|fakat|aber|jedoch|maar|echter)\b"

NEGATION = r"\b(?:no|not|without|absent|none|free of|negative for|sin|ausencia|nieg\w*|descarta\w*|yok\w*|izlenme(?:di|mis|me)\w*|saptanma(?:di|mis|ma)\w*|gorulme(?:di|mis|me)\w*|rastlanma(?:di|mis|ma)\w*|mevcut degil|kein\w*|ohne|nicht|frei von|negativ|geen|zonder|niet|afwezig\w*|vrij van)\b"
NEGATION_EXCEPTIONS = r"\b(?:non|not|no|nicht|niet)[ -]?(?:displaced|desplazad\w*|disloz\w*|disloc\w*|gedisloceerd\w*|deplase)|\bnondisplaced"
SEVERITY = r"\b(?:trace|minimal|minim\w*|tiny|small amount|leve|escas\w*|discret\w*|hafif|az miktarda|gering\w*|weinig)\b"
UNCERTAINTY = r"\b(?:subtle|possib\w*|probabl\w*|questionable|equivocal|borderline|suspicious|suspect\w*|cannot (?:be )?exclu\w*|may represent|may be|versus|physiologic\w*|rule out|posible\w*|dudos\w*|sospech\w*|suphe\w*|olasi|ekarte edilemez|fraglich\w*|moglich\w*|verdacht\w*|diskret\w*|nicht sicher|mogelijk\w*|twijfel\w*|verdenking|niet uit te sluiten)\b"
HEDGES = f"{SEVERITY}|{UNCERTAINTY}"
SIGNIFICANCE = r"\b(?:significant\w*|substantial|appreciable|significativ\w*|importante|belirgin|onemli|wesentlich\w*|relevant\w*|ausgepragt\w*|duidelijk\w*|noemenswaardig\w*)\b"

TEAR = r"\b(?:tear\w*|torn|ruptur\w*|disrupt\w*|discontinu\w*|full.thickness|partial.thickness|avuls\w*|rotura\w*|desgarr\w*|lesion\w*|yirti\w*|kopma|devamsizlik|riss\w*|durchtrenn\w*|scheur\w*|ruptuur)"
INTACT = r"\b(?:intact\w*|normal\w*|unremarkable|continuous|preserved|integr\w*|conservad\w*|dogal|saglam|intakt\w*|unauffallig\w*|regelrecht\w*|normaal|ongestoord)\b"


@dataclass(frozen=True)
class Finding:
    """A column and what speaks for it: terms that suffice alone, or a structure with a cue near by."""

    column: str
    alone: str = ""
    structure: str = ""
    pathology: str = TEAR
    integrity: str = INTACT
    window: int = 80
    #: A structure named without a cue counts as absent.
    mention_is_negative: bool = False


@dataclass(frozen=True)
class Cues:
    negation: str = NEGATION
    exceptions: str = NEGATION_EXCEPTIONS
    hedges: str = HEDGES
    significance: str = SIGNIFICANCE
    clause_ends: str = CLAUSE_ENDS


FINDINGS = [
    Finding("ACL", structure=r"\bacl\b|anterior cruciate|cruzado anterior|\blca\b|on capraz|\bvkb\b|vordere\w* kreuzband|voorste kruisband", mention_is_negative=True),
    Finding("MCL", structure=r"\bmcl\b|medial collateral|colateral medial|\blcm\b|\blli\b|ic yan bag|innenband|binnenband"),
    Finding("Medial Meniscus", alone=r"\binnenmeniskus(?:riss|lasion)|\bbinnenmeniscusscheur", structure=r"medial meniscus|menisco (?:interno|medial)|\bic menisk|innenmenisk|binnenmenisc"),
    Finding("Lateral Meniscus", alone=r"\baussenmeniskus(?:riss|lasion)|\bbuitenmeniscusscheur", structure=r"lateral meniscus|menisco (?:externo|lateral)|\bdis menisk|aussenmenisk|buitenmenisc"),
    Finding("Effusion", alone=r"\beffusion|joint fluid|\bderrame|\befuzyon|erguss|\bhydrops|gewrichtsvocht"),
    Finding("Synovitis", alone=r"\bsynovit|\bsinovit|synovial thickening|engrosamiento sinovial"),
    Finding("Baker's", alone=r"\bbaker\w*[ -]?(?:cyst|kist|zyste)|\bbakerzyste|popliteal (?:cyst|kist|zyste)|poplitealzyste|quiste (?:de baker|popliteo)"),
    Finding("Contusion", alone=r"\bcontusion|bone bruise|\bkontusion|\bkontuzyon|\bcontusie", structure=r"marrow (?:o?edema)|edema (?:oseo|medular)|kemik iligi odemi|knochenmarkodem|beenmergoedeem", pathology=r"\btrauma\w*|\binjur\w*|\bimpact\w*|\bcontus\w*", window=100),
    Finding("Fracture", alone=r"\bfractu\w*|\bfraktur|\bkirik|knochenbruch|botbreuk"),
]


@dataclass(frozen=True)
class Compartments:
    """Sections that carry over lines, and which column each one's findings go to."""

    columns: dict[str, str] = field(default_factory=lambda: {"pf": "PF OA", "medial": "Medial OA", "lateral": "Lateral OA"})
    #: In order of precedence: a medial patellar facet is patellofemoral.
    patterns: tuple[tuple[str, str], ...] = (("pf", r"patell|retropatellar|rotulian|trochlea"), ("medial", r"\bmedial|\bmediaal|\bintern[oa]\b|\binnen"), ("lateral", r"\blateral|\blateraal|\bextern[oa]\b|\baussen|\bbuiten"))
    explicit: str = r"osteoarthrit|\barthros|gonarthros|\bartros|\bartroz|osteophyt|osteofit|osteofyt|joint.space (?:loss|narrowing)|pinzamiento|chondromalac|chondropath|condropat|condromalac|spurring"
    cartilage: str = r"cartilag|chondral|condral|knorpel|kraakbeen|kikirdak"
    damage: str = r"\bloss|thinning|defect|ulcer|fissur|delaminat|\blesion|full.thickness|high.grade|verlust|schaden|verlies|\bkayb|adelgaz"
    intact: str = r"\bintact|\bnormal|preserved|unremarkable|sin alteraciones|geen afwijkingen|conservad|unauffallig"
    uncertainty: str = UNCERTAINTY
    header_end: str = ":"
    header_length: int = 80


OSTEOARTHRITIS = Compartments()

#: Parts of words that hint at a column at all, for the most that labels could reach. They are looked for in plain text.
PROBES = {
    "ACL": ["cruciat", "cruzado", "kreuzband", "kruisband", "capraz", r"\bacl\b", r"\blca\b", r"\bvkb\b", "σταυρ", "крест"],
    "MCL": ["collateral", "colateral", "kollateral", "innenband", "binnenband", "yan bag", r"\bmcl\b", r"\blcm\b", "πλαγ", "колла"],
    "Medial Meniscus": ["menisc", "menisk", "μηνισκ", "мениск"],
    "Lateral Meniscus": ["menisc", "menisk", "μηνισκ", "мениск"],
    "Medial OA": ["arthr", "artr", "osteo", "chondr", "kondr", "knorpel", "kraakbeen", "kikirdak", "degener", "αρθρ", "артро", "хондр"],
    "Lateral OA": ["arthr", "artr", "osteo", "chondr", "kondr", "knorpel", "kraakbeen", "kikirdak", "degener", "αρθρ", "артро", "хондр"],
    "PF OA": ["patell", "rotulian", "femoropat", "retropat", "chondromalac", "condromalac", "kondromalaz", "trochlea", "επιγονατ", "надколен"],
    "Effusion": ["effusion", "derrame", "efuzyon", "erguss", "hydrops", "vocht", "fluid", "liquid", "sivi", "υγρ", "выпот", "izliv"],
    "Synovitis": ["synov", "sinov", "υμεν", "синов"],
    "Baker's": ["baker", "popliteal", "poplite", "cyst", "quiste", "kist", "zyste", "cyste", "κύστ", "киста"],
    "Contusion": ["contus", "kontus", "bruise", "edema", "odem", "oedeem", "ödem", "οίδημα", "отек", "medul"],
    "Fracture": ["fractur", "fraktur", "kirik", "breuk", "bruch", "κάταγμα", "перелом", "prijelom"],
}

#: Words that tell languages apart by how many distinct ones a text has, and words that hardly any other language has, in plain form.
LANGUAGE_WORDS = {
    "en": "the and is of with no there are normal left right knee joint signal intact seen within mild".split(),
    "es": "de la el en se con los las del por un una rodilla observa signos sin articular aprecia".split(),
    "tr": "ve ile bir olan izlenmektedir mevcut diz eklem sinyal artis yoktur seviyesinde dogal olarak bulgu".split(),
    "de": "der die das und mit kein keine nicht im des bei kniegelenk unauffallig regelrecht nachweisbar zeigt".split(),
    "nl": "de het een en met geen van is zijn knie gewricht normale aanwezig wordt bij geringe".split(),
    "fr": "le la les des du avec pas une est genou articulaire sans signal aspect normale".split(),
    "pl": "w i na nie z do jest kolana stawu obraz bez oraz widoczne prawego".split(),
    "hr": "je se na u koljena bez sa od prikaz uredan zgloba nema lijevog desnog".split(),
    "it": "di il la del con non ginocchio articolare che una nella presenza".split(),
    "pt": "de da do com nao joelho articular sem que uma sinais".split(),
}
STRONG_WORDS = {
    "nl": "geen knie kraakbeen gewrichtsvocht kruisband meniscus".split(),
    "de": "kein keine kniegelenk knorpel kreuzband erguss".split(),
    "tr": "izlenmektedir izlenmedi saptanmadi meniskus menisk eklem".split(),
    "es": "rodilla menisco derrame ligamento observa".split(),
    "en": "meniscus effusion ligament tear unremarkable".split(),
}
