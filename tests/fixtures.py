"""Small drawings with answers that can be worked out by hand."""

from __future__ import annotations


def macro(name: str, points: dict[str, tuple[float, float]], curves: list[tuple[str, str, str]], plane: str = "YZ") -> str:
    """Macro text of a drawing in local coordinates."""
    place = {"YZ": lambda u, v: (0.0, u, v), "XZ": lambda u, v: (u, 0.0, v), "XY": lambda u, v: (-v, u, 0.0)}[plane]
    out = [f'S_1 = theModel.createSect( sectionName = "{name}")']
    out += [f"{p} = theModel.createSecNode( x = {x}, y = {y}, z = {z}, theSect = S_1)" for p, (u, v) in points.items() for x, y, z in [place(u, v)]]
    out += [f"{c} = theModel.createSecCurve( start = {a}, end = {b}, theSect = S_1)" for c, a, b in curves]
    return "\n".join(out) + "\ntheModel.drawModel()\n"


def square(size: float = 10.0):
    p = {"P1": (0, 0), "P2": (size, 0), "P3": (size, size), "P4": (0, size)}
    return p, [("L1", "P1", "P2"), ("L2", "P2", "P3"), ("L3", "P3", "P4"), ("L4", "P4", "P1")]


def ladder(gap: float = 0.0, inset: bool = False):
    """A 40 x 120 box with rungs at 40 and 80. gap: one rung is cut in two; inset: the rungs end on the walls without shared points."""
    p = {"A": (0, 0), "B": (40, 0), "C": (40, 120), "D": (0, 120), "E": (0, 40), "F": (40, 40), "G": (0, 80), "H": (40, 80)}
    if inset:
        c = [("L1", "A", "B"), ("L2", "B", "C"), ("L3", "C", "D"), ("L4", "D", "A")]
    else:
        c = [("L1", "A", "B"), ("L2", "B", "F"), ("L5", "F", "H"), ("L6", "H", "C"), ("L3", "C", "D"), ("L4", "D", "G"), ("L7", "G", "E"), ("L8", "E", "A")]
    c.append(("R1", "E", "F"))
    if gap:
        p |= {"M": (20 - gap / 2, 80), "N": (20 + gap / 2, 80)}
        c += [("R2", "G", "M"), ("R3", "N", "H")]
    else:
        c.append(("R2", "G", "H"))
    return p, c


def flange():
    p, c = square()
    return p | {"T": (16, 10)}, [*c, ("FL", "P3", "T")]


FIXTURES = {
    "square": square(), "ladder": ladder(), "t_rung": ladder(inset=True), "gap_rung": ladder(gap=2.0), "flange": flange(),
    "chain": ({"P1": (0, 0), "P2": (5, 0), "P3": (10, 1)}, [("L1", "P1", "P2"), ("L2", "P2", "P3")]),
    "branch": (square()[0], [*square()[1], ("D", "P1", "P3")]),
}
