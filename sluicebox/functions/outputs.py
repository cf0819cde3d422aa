"""Whether a program's result is the one expected. Stands alone: the verifier runs this file's text beside the program."""

import math

TOLERANCE = 1e-6
#: Nested deeper than this, or holding itself, a result can't be compared.
DEEPEST = 500


def flat(value):
    """Every place in a nested value and what stands there; a list or tuple, or a dict, is its kind and size."""
    places, todo = {}, [((), value)]
    while todo:
        place, here = todo.pop()
        if len(place) > DEEPEST:
            raise RecursionError("a result nested too deep")
        inside = None
        if isinstance(here, (list, tuple)):
            inside, places[place] = enumerate(here), ("sequence", len(here))
        elif isinstance(here, dict):
            inside, places[place] = here.items(), ("mapping", len(here))
        else:
            places[place] = here
        todo.extend(((*place, key), item) for key, item in inside or ())
    return places


def alike(one, other):
    """Plain values: a bool only with itself; with a float among two numbers, those within the tolerance; the rest if equal."""
    kinds = {bool: 0, int: 1, float: 2}
    a, b = (next((k for t, k in kinds.items() if isinstance(x, t)), 3) for x in (one, other))
    if 0 in (a, b):
        return one is other
    if {a, b} in ({2}, {1, 2}):
        return math.isclose(one, other, rel_tol=TOLERANCE, abs_tol=TOLERANCE)
    return one == other


def same_output(actual, expected):
    got, wanted = flat(actual), flat(expected)
    return got.keys() == wanted.keys() and all(alike(got[place], wanted[place]) for place in wanted)
