"""Fixed weights of the attention query."""

DIM, GATES = 64, 2
VW = [[((k * 7 + j * 3) % 11 - 5) / 10 for j in range(DIM)] for k in range(GATES)]
UW = [[((k * 5 + j * 2) % 7 - 3) / 10 for j in range(DIM)] for k in range(GATES)]
GW = [1.0, -0.5]
#: What is added to a series' vector for its plane, and the heads of two columns.
PLANES = {0: [((k * 3) % 5 - 2) / 20 for k in range(DIM)], 1: [((k * 2) % 7 - 3) / 20 for k in range(DIM)], 2: [0.0] * DIM}
HEADS = {"quality": [((k * 7) % 9 - 4) / 5 for k in range(DIM)], "toxic": [((k * 5) % 11 - 5) / 5 for k in range(DIM)]}
BIAS = {"quality": 0.25, "toxic": -0.5}
