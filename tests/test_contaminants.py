"""The contaminant list against all offsets, and all transcripts in it."""

import random

from strandframe.operators import etl


def test_contaminants_against_all_offsets(spark):
    r = random.Random(2)
    dna = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    known = {f"k{i}": dna(60) for i in range(30)}
    turned = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    keys = {dna(n) for n in (5, 8, 12, 25, 32)}
    for s in known.values():
        n, at = r.randint(8, 32), r.randrange(28)
        part = list(r.choice([s, turned(s)])[at:at + n])
        for _ in range(r.randrange(3)):
            part[r.randrange(n)] = r.choice("ACGT")
        keys.add("".join(part))

    def run(a, b):
        """Greatest (length, identity), the first of the longest, with at most one difference."""
        best = (0, 0)
        cur = last = mis = 0
        for x, y in zip(a, b):
            if x == y:
                cur, last = cur + 1, last + 1
            else:
                cur, last, mis = (cur + 1 if not mis else last + 1), 0, 1
            if cur > best[0]:
                best = (cur, mis)
        return best[0], (best[0] - best[1]) * 100 // max(1, best[0])

    want = {}
    for key in keys:
        for name, s in known.items():
            for t in (s, turned(s)):
                if 8 <= len(key) < 20 and key in t:
                    want[key] = max(want.get(key, (0, 0, "")), (len(key), 100, name))
                for o in range(20 - len(t), len(key) - 19) if len(key) >= 20 else ():
                    n, same = run(key[max(0, o):], t[max(0, -o):])
                    if n > 20:
                        want[key] = max(want.get(key, (0, 0, "")), (n, same, name))
    got = etl.contaminants(spark.createDataFrame([(k,) for k in keys], "key string"), spark.createDataFrame(list(known.items()), "name string, sequence string")).collect()
    assert {x.key: (x.length, x.identity, x.name) for x in got} == want and len(want) > 15


def test_contaminant_list_has_all_transcripts(spark):
    from strandframe.plans import catalogue

    names = {r.name for r in catalogue.QUERIES["contaminant_match"](spark, "/root/testdata/sf0.01").collect()}
    assert any(int(x[2:]) % 400 != 1 for x in names)
