"""Corpus operators against brute force on small tables, with nulls, empty and long texts, ties, repeats and odd columns."""

import hashlib
import random
import re
from zlib import crc32

import numpy as np
import pytest
import xxhash

from strandframe.llm import linedup, mixing, ordermin, packing, quality, queries, simhash, tokenfile, topk, toxicity, urlfilter
from strandframe.llm.common import components
from strandframe.llm.tokens import byte_encoder, public_path, word_encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _copy int, text_2 string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda omicron".split()


def sentence(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


ROWS = [
    (0, sentence(40, 1) + "\n" + sentence(30, 2), "en", "a", 10, 1, "x"),
    (1, sentence(40, 1) + "\n" + sentence(30, 2), "en", "a", None, 1, None),
    (2, sentence(40, 1) + " more\n" + sentence(25, 3), None, "b", 10, None, "x"),
    (3, None, "en", None, None, 1, "x"),
    (4, "", None, "b", 0, 1, "x"),
    (5, "  \n \t", "de", "", 3, 1, "x"),
    (6, sentence(6000, 4), "en", "c", 9, 1, "x"),
    (7, "é́ ß. \x00 It's", "fr", "c", 5, 1, "x"),
    (8, "one", "en", "c", 3, 1, "x"),
    (8, "one", "en", "c", 3, 1, "x"),
    (None, "no id at all here now", "en", "d", 3, 1, "x"),
    (11, "<|endoftext|> a b c", "en", "d", 3, 1, "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(doc_id):
    return (doc_id is not None, doc_id or 0)


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (102, 101), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    parts = [b" ".join(words[i: i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def connected(values, near):
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(values))]


def test_simhash(docs, none):
    rows = sorted((r for r in ROWS if r[0] is not None), key=lambda r: key(r[0]))
    prints = [fingerprint(r[1]) for r in rows]
    roots = connected(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    want = sorted((r[0], format(p, "016x"), rows[x][0]) for r, p, x in zip(rows, prints, roots, strict=True))
    got = simhash.near_duplicates(docs).collect()
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == want
    assert len(got) == len(ROWS)
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.deduplicate(docs).columns == docs.columns


@pytest.mark.parametrize("limit", [2, 32])
def test_simhash_links_lose_nothing(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "PAIR_LIMIT", limit)
    r = random.Random(5)
    values = set()
    for _ in range(12):
        x = r.getrandbits(64)
        values.add(x)
        for _ in range(15):
            x ^= 1 << r.randrange(64)
            if r.random() < 0.5:
                x ^= 1 << r.randrange(64)
            values.add(x)
    values = sorted(values)
    rows = [(simhash.signed(v), i) for i, v in enumerate(values)]
    edges = simhash.links(spark.createDataFrame(rows, "fp long, rep long"))
    found = {x.node: x.component for x in components(edges).collect()}
    assert [found.get(i, i) for i in range(len(values))] == connected(values, lambda a, b: (a ^ b).bit_count() <= 2)


def test_packing(docs, none):
    from tokenizers import Tokenizer

    path = public_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want = []
    for r in ROWS:
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 0]
        want += [(key(r[0]), i, at, len(ids[at: at + 2048]), crc32(np.array(ids[at: at + 2048], "<u4").tobytes())) for i, at in enumerate(range(0, len(ids), 2048))]
    got = packing.pack(docs, path).collect()
    assert sorted((key(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert packing.pack(none, path).count() == 0


def test_plan_is_best_fit():
    r = random.Random(1)
    for _ in range(50):
        counts = {r.randrange(1, 101): r.randrange(1, 200) for _ in range(r.randrange(1, 40))}
        slots = packing.plan(counts, 100)
        rooms = {}
        for n, c in counts.items():
            assert sorted(x for length, a, b, *_ in slots if length == n for x in range(a, b)) == list(range(c))
        for length, a, b, first, offset in slots:
            for i in range(b - a):
                rooms.setdefault(first + i, []).append((offset, length))
        for parts in rooms.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= 100
        assert len(rooms) <= 1.2 * sum(n * c for n, c in counts.items()) / 100 + 1 or max(counts) > 50


def test_token_encoders_equal_the_tokenizer():
    from tokenizers import Tokenizer

    r = random.Random(1)
    texts = ["".join(r.choice("aB .,\n'\t0é \x00\x01sΣ²|!́\x1c") for _ in range(r.randint(0, 30))) for _ in range(3000)] + [x[1] or "" for x in ROWS]
    texts += ["a <|endoftext|> b", "a<|ENDOFTEXT|>b <|endoftext|><|startoftext|>", "word,.\n\nnext\n", "thé,### a$$ b."]
    for name, made in (("word_bpe_49k.json", word_encoder), ("byte_bpe_50k.json", byte_encoder)):
        t = Tokenizer.from_file(public_path(name))
        assert list(made(public_path(name)).encode(texts)) == [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]


def test_token_files(docs, none, tmp_path):
    path = public_path("byte_bpe_50k.json")
    files = tokenfile.write(docs, str(tmp_path), path, frame=4096)
    got = sorted(tokenfile.read(files).collect(), key=lambda r: r.start)
    encode = byte_encoder(path).encode
    at = 0
    for r, (doc_id, text) in zip(got, sorted(((r[0], r[1] or "") for r in ROWS), key=lambda x: (key(x[0]), x[1])), strict=True):
        (ids,) = encode([text])
        ids += (2).to_bytes(4, "little")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, at, len(ids) // 4, crc32(ids))
        at += len(ids) // 4
    for f in files.collect():
        reader = tokenfile.open_reader(f.file)
        whole = list(reader.documents())
        assert [reader.document(i) for i in reversed(range(len(whole)))] == [ids for *_, ids in reversed(whole)]
    assert tokenfile.read(tokenfile.write(none, str(tmp_path / "none"), path)).count() == 0
    name = next(f.file for f in files.collect() if f.ids > 5000).removeprefix("file://")
    data = bytearray(open(name, "rb").read())
    data[200] ^= 1
    open(name, "wb").write(data)
    with pytest.raises(Exception):
        list(tokenfile.open_reader(name).documents())


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS)
    size = {}
    for r in ROWS:
        size[r[3]] = size.get(r[3], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(size.values()), {}
    while True:
        free = [s for s in order if s not in full]
        rest, by = total - sum(full.values()), sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / by > 2 * size[s]]
        if not over:
            break
        full |= {s: 2.0 * size[s] for s in over}
    for r in got:
        assert r.source_size == size[r.source]
        assert r.target == pytest.approx(full.get(r.source, rest * weight[r.source] / by))
        assert 0 <= r.taken <= 2 * r.size
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(none).count() == 0


def test_mixed_documents(spark, none):
    """Each row by itself: without an id, with a shared one, in columns of any names."""
    rows = [(None, "one two three", "a", 1, 2), (None, "four five", "a", 1, 2), (7, "six", "b", 3, 4), (7, "seven eight nine ten", "b", 5, 6), (8, None, None, 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _copies int, _copy int")
    plan = mixing.mix(docs).collect()
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    assert sum(r.taken for r in plan) == sum(len((r.text or "").split()) for r in got.collect()) > 0
    assert {r.doc_id for r in got.collect()} >= {None, 7} and mixing.mixed_documents(none).count() == 0


def test_mixing_comes_near_targets(spark):
    r = random.Random(2)
    rows = [(i, " ".join(["w"] * r.randrange(1, 60)), r.choice("abcdefg")) for i in range(3000)]
    taken, target = {}, {}
    for x in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        taken[x.source] = taken.get(x.source, 0) + x.taken
        target[x.source] = x.target
    assert all(abs(taken[s] - target[s]) <= 30 for s in taken)


def test_order_minhash(docs, none):
    got = {}
    for r in ordermin.fingerprints(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    rows = sorted(((r[0], r[1] or "") for r in ROWS), key=lambda x: (key(x[0]), x[1]))
    prints = {}
    for i, (doc_id, text) in enumerate(rows):
        n = len(text) // 4
        edited = text[: len(text) - n] + rows[(i + 1) % len(rows)][1][:n]
        shas = {r.edited_sha256 for r in got[doc_id]}
        assert hashlib.sha256(edited.encode()).hexdigest() in shas
        for r in got[doc_id]:
            assert r.n_chars == len(text)
            prints.setdefault(text, set()).add(r.fingerprint)
            assert 0 <= r.near_edited <= 1
    assert all(len(p) == 1 for p in prints.values())
    assert got[6][0].near_edited > 0.1 > got[6][0].near_next
    assert got[0][0].near_next == 1
    assert ordermin.fingerprints(none).count() == 0


def test_order_minhash_sees_order_and_repeats(spark):
    a = [f"w{i}" for i in range(200)]
    texts = [" ".join(a), " ".join(a[100:] + a[:100]), " ".join(a + a)]
    df = spark.createDataFrame(list(enumerate(texts)), "key int, text string")
    s = {r.key: r.signature for r in ordermin.signatures(df, ["key"]).collect()}
    like = lambda x, y: sum(p == q for p, q in zip(s[x], s[y])) / len(s[0])
    assert 0 < like(0, 1) < 0.95  # the same words in another order: entries whose pair is turned differ
    assert like(0, 2) < 0.9  # occurrence numbers make the repeats other k-mers


def test_top_k(spark):
    r = random.Random(3)
    rows = [(i, [r.uniform(-1, 1) for _ in range(9)], 0, "x") for i in range(300)]
    rows += [(300, None, 0, "x"), (350, [float("nan")] * 9, 0, "x"), (301, [None, 1.0], 0, "x"), (302, [float("inf")] * 9, 0, "x"), (None, [1.0] * 9, 0, "x"), (7, rows[7][1], 0, "x"), (303, rows[8][1], 0, "x"), (304, [0.5], 0, "x")]
    v = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, list string"))
    got = [tuple(x) for x in topk.top_k(v, v.where("vec_id % 50 = 0"), 5).collect()]
    data = [(i, np.pad(np.floor(256 * np.array(x, np.float32).astype(float)), (0, 9 - len(x))).astype(int)) for i, x, *_ in rows if i is not None and x is not None and None not in x and np.isfinite(x).all()]
    want = []
    for q, x in data:
        if q % 50 == 0:
            best = sorted((-int(x @ y), i) for i, y in data if i != q)[:5]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert sorted(got) == sorted(want)
    few = v.where("vec_id in (0, 1, 2)")
    assert topk.top_k(few, few, 5).count() == 6
    assert topk.top_k(v.limit(0), v.limit(0), 5).count() == 0


def test_urls(spark):
    entries = [("bad.com", "a", "add", "2024-01-10"), ("bad.com", "a", "remove", "2024-02-01"), ("x.bad.com", "b", "add", "2024-01-20"), ("x.bad.com", "b", "add", "2024-03-01"), ("tie.com", "a", "add", "2024-01-01"), ("tie.com", "a", "remove", "2024-01-01"), (None, "a", "add", "2024-01-01")]
    e = spark.createDataFrame(entries, "domain string, category string, action string, dated string")
    pages = [(1, "http://bad.com/x", "2024-01-09 23:59:59"), (2, "http://u@BAD.com.:80?q", "2024-01-10 00:00:00"), (3, "https://y.x.bad.com", "2024-01-25 00:00:00"), (4, "https://x.bad.com", "2024-02-01 00:00:00"), (5, "http://notbad.com", "2024-01-15 00:00:00"),
             (6, None, "2024-01-15 00:00:00"), (7, "http://bad.com", None), (8, "http://tie.com", "2024-01-02 00:00:00"), (9, "bad.com", "2024-01-15 00:00:00"), (1, "http://bad.com/x", "2024-01-09 23:59:59")]
    got = urlfilter.judge(spark.createDataFrame(pages, "page_id long, url string, fetched string"), e).collect()
    assert sorted((r.page_id, r.blocked, r.matched_domain, r.n_active) for r in got) == sorted([(1, False, None, 0), (1, False, None, 0), (2, True, "bad.com", 1), (3, True, "x.bad.com", 2), (4, True, "x.bad.com", 1), *[(i, False, None, 0) for i in range(5, 10)]], key=lambda x: x[:2])


def test_lines(docs, none, spark):
    got = {}
    for r in linedup.deduplicate(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert got[0][0].n_dropped == 0 and got[0][0].text == ROWS[0][1]
    assert got[1][0].n_dropped == 2 and got[1][0].text == ""
    assert got[3][0].text is None and got[4][0].text == "" and got[8][0].text == "one"
    assert got[None][0].text == "no id at all here now" and len(got[8]) == 2
    assert linedup.deduplicate(none).count() == 0
    assert set(linedup.deduplicate(docs).columns) == {*docs.columns, "n_lines", "n_dropped"}


@pytest.mark.parametrize("most, dense", [(2048, 8), (3, 8), (2048, 0)])
def test_lines_near(spark, monkeypatch, most, dense):
    """Edited lines against all pairs: full buckets, dense ones and plain ones drop the same kind of lines."""
    monkeypatch.setattr(linedup, "RUN", most)
    monkeypatch.setattr(linedup, "DENSE", dense)
    monkeypatch.setattr(linedup, "TILE", 4)
    monkeypatch.setattr(linedup, "HOLD", 300)
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9)))
    lines = []
    for g in range(40):
        base = [word() for _ in range(r.randint(8, 60))]
        lines += [" ".join(word() if r.random() < rate else w for w in base) for rate in [0, 0.02, 0.05, 0.1, 0.1, 0.3][: r.randint(1, 6)]]
    lines += [lines[0].upper() + "!"]
    sims = linedup.simhashes([x.split() for x in map(linedup.normalise, lines)])

    def dropped(linked):
        low = list(range(len(lines)))
        for _ in range(len(lines)):
            new = [min([low[i]] + [low[j] for j in range(len(lines)) if linked[i][j]]) for i in range(len(lines))]
            if new == low:
                break
            low = new
        return {i for i, x in enumerate(low) if x != i}

    norm = [" ".join(linedup.normalise(x).split()) for x in lines]
    similar = [[i != j and linedup.edit_similar(a, b) for j, b in enumerate(norm)] for i, a in enumerate(norm)]
    near = [[x and int(sims[i] ^ sims[j]).bit_count() <= linedup.BITS for j, x in enumerate(row)] for i, row in enumerate(similar)]
    rows = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {x.doc_id for x in linedup.deduplicate(rows).collect() if x.n_dropped}
    least, greatest = dropped(near), dropped(similar)
    assert least <= got <= greatest and len(got) >= 0.8 * len(greatest) and len(least) > 20


def test_lines_of_rows_that_share_an_id(spark):
    """A line goes where it repeats one; rows of one doc_id are told apart by their texts; any names of columns do."""
    a, b = "a line of words that two of the rows have", "this line here is in one row and nowhere else"
    rows = spark.createDataFrame([(1, a, 1, 2, 3), (2, a, 1, 2, 3), (2, b, 1, 2, 3), (3, f"{b} it says\n{a}\nx", 4, 5, 6)], "doc_id long, text string, _id int, _drop int, drop int")
    got = sorted((r.doc_id, r.text, r.n_dropped, r._id, r._drop, r["drop"]) for r in linedup.deduplicate(rows).collect())
    assert got == [(1, a, 0, 1, 2, 3), (2, "", 1, 1, 2, 3), (2, b, 0, 1, 2, 3), (3, "x", 2, 4, 5, 6)]


def test_normalised_lines():
    """The quick way over bytes gives the lines of the plain one."""
    r = random.Random(2)
    for alphabet in ("aB 1,.\n\t\r\x0b\x1c\x85\xa0éß²µÀ×-_'", "aB 1,.\n\t\u2028\u3000éßŁΣ☃'"):
        for _ in range(500):
            text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))
            plain = re.sub(r"[0-9]+", "0", re.sub(r"[^\w\s]+", " ", text.lower()))
            assert linedup.normalised_lines(text) == [" ".join(x.split()) for x in plain.split("\n")], repr(text)


def test_lines_near_in_a_table_of_any_size(spark, monkeypatch):
    """As many near lines are found if the table is said to have 2^27 lines."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(4, 9)))
    lines = []
    for _ in range(200):
        base = [word() for _ in range(20)]
        lines += [" ".join(base), " ".join(word() if i in (3, 11) else w for i, w in enumerate(base))]
    rows = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    dropped = lambda: {x.doc_id for x in linedup.deduplicate(rows).collect() if x.n_dropped}
    small = dropped()
    monkeypatch.setattr(linedup, "TASK_KEYS", 1 << 60)
    monkeypatch.setattr(type(rows), "count", lambda self: 1 << 27)
    assert len(small) > 100 and dropped() == small


@pytest.mark.parametrize("most, dense", [(2048, 8), (2, 8)])
def test_short_lines_near(spark, monkeypatch, most, dense):
    """Lines of 5 to 7 words against all pairs: every line with an edit similarity of 0.8 to an earlier one goes."""
    monkeypatch.setattr(linedup, "RUN", most)
    monkeypatch.setattr(linedup, "DENSE", dense)
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(4, 9)))
    lines = []
    for _ in range(150):
        base = [word() for _ in range(r.randint(5, 7))]
        new = list(base)
        for i in r.sample(range(len(base)), r.randint(1, 2)):
            at = r.randrange(len(new[i]))
            new[i] = r.choice([new[i][:at] + "q" + new[i][at + 1:], new[i][:at] + new[i][at + 1:], new[i] + "s", new[i] + " q", word()])
        lines += [" ".join(base), " ".join(new)]
    near = {j for j, b in enumerate(lines) for a in lines[:j] if linedup.edit_similar(a, b)}
    rows = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {x.doc_id for x in linedup.deduplicate(rows).collect() if x.n_dropped}
    assert len(near) > 80 and got == near


def test_lines_of_few_words(spark):
    """Exact repeats of any line that is not blank go, and near ones of long lines without blanks."""
    url = "https://example.org/" + "".join(random.Random(3).choice("abcdefghijklmnop") for _ in range(200))
    texts = ["All rights reserved.\n\n-----\nab", "all rights  reserved\n\n-----\nac\n=====", url, url[:150] + "q" + url[151:], "ab"]
    got = {x.doc_id: (x.text, x.n_dropped) for x in linedup.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: (texts[0], 0), 1: ("\nac\n=====", 2), 2: (url, 0), 3: ("", 1), 4: ("", 1)}


def test_edit_similarity():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            new = [i]
            for j, d in enumerate(b, 1):
                new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
            row = new
        return row[-1]

    r = random.Random(4)
    for _ in range(2000):
        a = "".join(r.choice("abc ") for _ in range(r.randint(1, 25)))
        b = "".join(c if r.random() < 0.85 else r.choice(["", "d", "bc"]) for c in a)
        assert not b or linedup.edit_similar(a, b) == (distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9))


def labelled(spark):
    r = random.Random(6)
    docs, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        text = sentence(40, i) + (" " + " ".join(r.sample(["scum", "idiot", "moron", "trash"], 2)) if bad else "")
        docs.append((i, text if i % 7 else text.replace(" ", " | "), "en", "s", len(text)))
        labels += [(i, int(i % 7 != 0), int(bad))] if i % 3 else []
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity(spark, docs, none):
    made, labels = labelled(spark)
    got = {r.doc_id: r for r in toxicity.score(made, labels).collect()}
    assert all(got[i].predicted == int(i % 4 == 0) for i in got)
    assert all(got[i].held_out == (crc32(str(i).encode()) % 4 == 2) for i in got)
    odd = toxicity.score(docs, labels).collect()
    assert len(odd) == len(ROWS) and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.score(none, labels).count() == 0
    assert toxicity.score(docs, labels.limit(0)).count() == len(ROWS)


def test_toxicity_learns_nothing_from_held_out_rows(spark):
    made, labels = labelled(spark)
    from pyspark.sql import functions as F

    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in toxicity.score(made, x).collect()} for x in (labels, turned))
    assert a == b


def test_quality(spark, docs, none):
    made, labels = labelled(spark)
    got = {r.doc_id: r for r in quality.score(made, labels).collect()}
    assert np.mean([got[i].keep == (i % 7 != 0) for i in got]) > 0.98
    assert len(quality.score(docs, labels).collect()) == len(ROWS)
    assert quality.score(none, labels).count() == 0
    assert quality.score(docs, labels.limit(0)).where("keep").count() == len(ROWS)
    assert quality.kept(docs, labels).columns == docs.columns


@pytest.mark.parametrize("rows", [10, 2500])
def test_quality_counts_all_letters(rows):
    text = ("a" * 14 + "0" * 6) * rows
    assert quality.content(text)[quality.HASHED + 7] == pytest.approx(0.7)


def test_quality_learns_from_all_documents(spark, monkeypatch):
    """The moments that executors gather are those of every document without a label that a view is sure of."""
    made, labels = labelled(spark)
    real, seen = quality.train, {}

    def train(views, y, given):
        model = real(views, y, given)
        seen.update(model=model, sums=given(model))
        return model

    monkeypatch.setattr(quality, "train", train)
    assert quality.score(made, labels).count() == 600
    known = {r.doc_id for r in labels.collect()}
    rows = [r for r in made.collect() if r.doc_id not in known]
    views = [np.stack(x).astype(np.float32).astype(float) for x in zip(*[(quality.content(r.text), quality.metadata(list(map(len, r.text.split("\n"))), r.n_chars, r.lang, r.source)) for r in rows])]
    scores = seen["model"].score(views)
    for v in (0, 1):
        p = scores[1 - v]
        sure = (p >= 0.95) | (p <= 0.05)
        assert np.allclose(seen["sums"][v], quality.moments(views[v][sure], (p[sure] >= 0.5).astype(float)))
    assert seen["sums"][1][-2, -2] > 100


def test_quality_of_documents_not_learnt_from(spark):
    made, labels = labelled(spark)
    scored = quality.score(made, labels.where("doc_id % 2 = 0")).where("doc_id % 2 = 1").collect()
    assert np.mean([r.keep == (r.doc_id % 7 != 0) for r in scored]) > 0.98


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "mixing to target weights", "best-fit packing"]
    sf = "/root/testdata/sf0.001"
    rows = corpus_pipeline.run(spark, sf).collect()
    ids = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    assert rows and {r.doc_id for r in rows} <= ids
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        assert sum(n for _, n in parts) <= 2048 and max(o + n for o, n in parts) == sum(n for _, n in parts)


def test_sql(spark):
    import duckdb

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("embeddings", "pages"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in queries.SQL.items():
        got, want = queries.QUERIES[name](spark, sf).toPandas(), con.sql(sql).df()
        cols = sorted(want.columns)
        assert sorted(got.columns) == cols
        assert sorted(map(str, got[cols].astype(str).values.tolist())) == sorted(map(str, want[cols].astype(str).values.tolist()))
