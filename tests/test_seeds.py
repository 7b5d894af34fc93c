"""Seeds and chains of small made tables."""

from strandframe.operators import kmers


def test_cutoff_grows_with_the_index(spark):
    """Hashes that all have 60 places are kept; one of 6,000 that has far more goes, as the quantile says."""
    rows = spark.range(6000 * 60).selectExpr("id as tx_id", "0 as pos", "id % 6000 as hash")
    more = spark.range(500).selectExpr("id as tx_id", "1 as pos", "7L as hash")
    queries = spark.range(6000).selectExpr("id as read_id", "0 as pos", "id as hash")
    assert kmers.occurrence_cutoff(rows) == 61
    got = kmers.seeds(queries, rows.union(more))
    assert got.count() == 5999 * 60 and got.where("hash = 7").count() == 0


def test_chain_looks_back_over_many_seeds(spark):
    """Sixty seeds off the line lie between two that chain."""
    rows = [(1, 1, 0, 0), *[(1, 1, 5000 - i, 1 + i) for i in range(60)], (1, 1, 100, 100)]
    got = kmers.chains(spark.createDataFrame(rows, "read_id long, tx_id long, q_pos int, t_pos int").selectExpr("*", "0L as hash"), 7).collect()
    assert [(r.score, r.n_seeds) for r in got] == [(14.0, 2)]


def test_sketch_against_all_windows():
    """Minimizers by windows one at a time, and by hash64 of plain integers."""
    import random

    def mix(x, bits):
        mask = (1 << bits) - 1
        x = (~x + (x << 21)) & mask
        x ^= x >> 24
        x = (x + (x << 3) + (x << 8)) & mask
        x ^= x >> 14
        x = (x + (x << 2) + (x << 4)) & mask
        x ^= x >> 28
        return (x + (x << 31)) & mask

    r = random.Random(3)
    for k, w in ((7, 5), (15, 10), (5, 3), (19, 19)):
        seqs = ["".join(r.choices("ACGTN", [20, 20, 20, 20, rate])[0] for _ in range(r.randint(0, 120))) for rate in (0, 1, 6) for _ in range(40)] + ["", "A", "ACGT" * 20, "A" * 60]
        want = []
        for s, seq in enumerate(seqs):
            found = {}
            for i in range(len(seq) - k + 1):
                a = seq[i: i + k]
                if "N" not in a:
                    x, y = (int("".join(str("ACGT".index(c)) for c in z), 4) for z in (a, a[::-1].translate(str.maketrans("ACGT", "TGCA"))))
                    found[i] = (mix(min(x, y), 2 * k), int(y < x))
            chosen = set()
            for i in range(len(seq)):
                window = [j for j in range(i, i + w) if j in found]
                if len(window) == w:
                    chosen |= {j for j in window if found[j][0] == min(found[x][0] for x in window)}
            if end := [j for j in found if j > len(seq) - k - w]:
                chosen.add(min(end, key=lambda j: (found[j][0], -j)))
            want += [(s, j, *found[j]) for j in sorted(chosen)]
        assert list(zip(*(x.tolist() for x in kmers.sketch(seqs, k, w)))) == want


def test_runs_over_blocks(spark):
    from itertools import groupby

    from strandframe.functions import headers

    cells = list("aaabbbbbbbbbbbcaaaaddd") + [None, None, "d"]
    rows = spark.createDataFrame([(2 * i, c) for i, c in enumerate(cells)], "read_id long, flowcell string")
    want, at = [], 0
    for c, g in groupby(cells):
        n = len(list(g))
        want.append((c, 2 * at, 2 * (at + n - 1), n))
        at += n
    for block in (1, 3, 7, 1000):
        assert sorted(map(tuple, headers.flowcell_runs(rows, block).collect()), key=lambda x: x[1]) == want
