"""What is written out for texts of one shape against reading each text itself."""

import random

from tracewell.functions import dataflow, lines
from tracewell.functions.shapes import Remembered

from .program_sources import SOURCES

ODD = [
    ("a.js", "const P1 = '/v1'\nconst A22 = '/a%d'\napp.get(P1 + '/22' + A22, f)\napp.get('/x1' + Q2 + '/1', g)\n"), ("b.js", "app.get('/%s/100%', f1); app.put('/1' + '2', f2)\n"), ("c.py", "def f1(x2):\n    return f12(x2, 3.14, 0x1F)\nf1(1)\nf12(12)\n"),
    ("d.py", "x = '''1\n 22''' ; def f2(): pass\n  y1 = 'a\0b'\n"), ("e.py", "é1 = input()\neval(é1)\n"), ("f.sql", "select a1 from t1 join t2 -- t3\n"), ("g.py", "\n".join(f"v{i} = 'k{i * 7919}'" for i in range(400))), ("h.py", "n" + "1" * 5000), ("i.py", "%d"),
]


def read(text, family):
    tokens = lines.Tokens(text, family)
    return dict.fromkeys(row for reader in lines.READERS for row in reader(tokens, family))


def flow(text, family):
    return dict.fromkeys(row[1:] for row in dataflow.Reader("", text, family).rows)


def test_same_rows_and_few_readings():
    r = random.Random(5)
    for plain in (read, flow):
        asked = []
        known = Remembered(lambda text, family, plain=plain, asked=asked: (asked.append(text), plain(text, family))[1])
        texts = [(p, t) for p, t in SOURCES + ODD if p and t]
        for _ in range(40):
            texts += [(p, "".join(str(r.randrange(10)) if c.isascii() and c.isdigit() else c for c in t)) for p, t in texts[: len(SOURCES)] + texts[-4:] if p and t]
        for p, t in texts:
            family = lines.FAMILIES.get(p.rpartition(".")[2].lower())
            if family:
                assert list(known(t, family)) == list(plain(t, family)), t[:300]
        alike = [f"def step_{i}_2(x):\n    y = step_{i}_3(x)\n    return y\nfrom orders.o{i}.step3 import step_{i}_3\n" for i in range(1000, 3000)]
        asked.clear()
        assert [list(known(t, "python")) for t in alike] == [list(plain(t, "python")) for t in alike]
        assert len(asked) <= 4  # those whose number ends up as 2 or 3 elsewhere, and so on, have shapes of their own
