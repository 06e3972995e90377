"""The interval join of secret parts against its definition, pair by pair."""

import random

from seqmine.llm.op2_secrets import NEEDS, ROLE, STRONG, _SCOPE, linked


def by_definition(text, strong, weak, reach):
    inside = lambda w: any(a <= w[0] and w[1] <= b for a, b, _ in strong)
    weak = [w for w in weak if not inside(w)]
    cuts = [m.start() for m in _SCOPE.finditer(text)]
    out = []
    for a, b, kind in weak:
        low = max([a - reach, 0, *(c for c in cuts if c < a)])
        high = min([b + reach, len(text), *(c for c in cuts if c >= a)])
        for x, y, other in strong + weak:
            if ROLE[other] in NEEDS[kind] and x < high and y > low and (other in STRONG or y <= a or x >= b):
                out.append((a, b, kind))
                break
    return out


def test_links_by_definition():
    rnd = random.Random(4)
    for _ in range(400):
        n = rnd.randrange(20, 400)
        text = "".join(rnd.choice("ab \n\n") for _ in range(n))
        span = lambda kinds: (lambda a: (a, rnd.randrange(a + 1, min(n, a + rnd.choice((5, 40, 200))) + 1), rnd.choice(kinds)))(rnd.randrange(n))
        strong = [span(("assign", "access", "hex")) for _ in range(rnd.randrange(4))]
        weak = [span(("identifier", "secret", "endpoint")) for _ in range(rnd.randrange(8))]
        for reach in (5, 30, 200):
            assert linked(text, strong, weak, reach) == by_definition(text, strong, weak, reach)
