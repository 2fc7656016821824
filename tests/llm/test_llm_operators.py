import gzip
import hashlib
import base64
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers as P

from tessera.llm import chat_format, jaccard_join, language_id, line_dedup, near_vectors, packing, piece_coding, quality, secret_scan, token_count

DOC = "doc_id long, text string, lang string, source string, n_chars long, sig long, kept string, _gone string, key long"


def word(r):
    return "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))


def sentence(r, n):
    return " ".join(word(r) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    base = [" ".join(sentence(r, 12) for _ in range(6)) for _ in range(12)]
    texts = base + base[:3] + [b.replace(b.split()[40], "changed") for b in base[:4]]
    texts += [None, "", " \t\n ", "one two", "ab cd ef", "x" * 30000, "\n".join([sentence(r, 9)] * 4), "password: hunter2secret\n" + base[0]]
    out = [(i, t, "en" if i % 2 else "de", "s", None if t is None else len(t), 1, "k", "g", 5) for i, t in enumerate(texts)]
    return [*out, out[0], (None, "a row without an id but with several words in it.", None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def components(n, links):
    at = list(range(n))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_op1_against_all_pairs(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(8, 16))
    vecs = [b + r.normal(size=16) * 0.03 for b in base for _ in range(12)]
    rows = [(i, v.astype("float32").tolist(), i % 2) for i, v in enumerate(vecs)]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], None), (202, None, 0), (203, [0.0] * 16, 0), (204, [float("nan")] * 16, 0), (205, [None] + [1.0] * 15, 0), (206, [1.0], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = {x.vec_id: x for x in near_vectors.near_vectors(df).collect()}
    live = [x for x in rows if x[0] is not None and x[2] is not None and x[1] and len(x[1]) == 16 and all(c is not None and np.isfinite(c) for c in x[1]) and any(x[1])]
    x = np.array([v[1] for v in live], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = [(i, j) for i in range(len(live)) for j in range(i + 1, len(live)) if live[i][2] == live[j][2] and x[i] @ x[j] >= 0.98]
    count = Counter(k for p in links for k in p)
    comp = components(len(live), links)
    assert len(links) > 50
    for k, v in enumerate(live):
        assert (got[v[0]].n_links, got[v[0]].component_id) == (count[k], live[comp[k]][0])
        assert got[v[0]].kept == (v[0] == live[comp[k]][0])
    for i in range(201, 207):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert len(got) == len(rows)
    # Rows that repeat are one vector.
    some = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [1.0, 0.01], 0), (3, [1.0, 0.01], 0)], "vec_id long, embedding array<float>, label int")
    assert sorted(tuple(x) for x in near_vectors.near_vectors(some).collect()) == [(1, 2, 1, True)] * 2 + [(2, 2, 1, False)] + [(3, 2, 1, False)] * 2
    # Large buckets are dealt as pairs of chunks: nothing counts twice.
    old, near_vectors.BLOCK = near_vectors.BLOCK, 4
    try:
        small = near_vectors.blocks.__defaults__
        near_vectors.blocks.__defaults__ = (4,)
        again = {y.vec_id: y.n_links for y in near_vectors.near_vectors(df).collect()}
    finally:
        near_vectors.BLOCK, near_vectors.blocks.__defaults__ = old, small
    assert again == {k: v.n_links for k, v in got.items()}
    assert near_vectors.near_vectors(df.limit(0)).count() == 0


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d = d, [i]
        for j, y in enumerate(b, 1):
            d.append(min(p[j] + 1, d[-1] + 1, p[j - 1] + (x != y)))
    return d[-1]


def test_banded_distance():
    r = random.Random(5)
    for _ in range(3000):
        a = "".join(r.choice("abc") for _ in range(r.randint(0, 9)))
        b = "".join(r.choice("abc") for _ in range(r.randint(0, 9)))
        for e in (1, 2, 3):
            assert line_dedup.within(a, b, e) == (distance(a, b) <= e)


def test_banded_words_against_the_table():
    r = random.Random(6)
    for t in line_dedup.BANDS:
        a = ["".join(r.choice("abcd ") for _ in range(r.randint(2 * t, 150))) for _ in range(150)]
        b = [list(s) for s in a]
        for s in b:
            for _ in range(r.randint(0, t + 3)):
                s[r.randrange(len(s))] = r.choice(["", "z", "zq"])
        pairs = [(x, "".join(y)) for x, y in zip(a, b, strict=True) if abs(len(x) - len("".join(y))) <= t]
        got = line_dedup.banded(*map(list, zip(*pairs, strict=True)), t)
        want = np.array([distance(x, y) for x, y in pairs])
        assert ((got <= t) == (want <= t)).all() and (got[want <= t] == want[want <= t]).all()
    lines = [sentence(r, r.randint(3, 200)) for _ in range(60)]
    near = ["".join(c if r.random() > 0.04 else "z" for c in s) for s in lines]
    assert line_dedup.near_lines(lines, near).tolist() == [distance(x, y) <= max(2, min(len(x), len(y)) // 20) for x, y in zip(lines, near, strict=True)]


def test_op2_against_all_pairs(spark, none):
    r = random.Random(9)
    lines = [sentence(r, 7) for _ in range(60)]
    for _ in range(60):
        s = list(r.choice(lines))
        for _ in range(r.randint(1, 3)):
            k = r.randrange(len(s))
            s[k : k + r.randint(0, 1)] = r.choice(["", "z", "y"])
        lines.append("".join(s))
    r.shuffle(lines)
    texts = ["\n".join(lines[i : i + 4]) for i in range(0, 120, 4)] + [None, "", "short\nshort"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {(x.doc_id, x.line_no): (x.first_doc, x.first_line, x.kept) for x in line_dedup.line_classes(df).collect()}
    places = [(d, n, s) for d, t in enumerate(texts) for n, s in line_dedup.lines_of(t, line_dedup.MIN_CHARS)]
    links = [(i, j) for i in range(len(places)) for j in range(i + 1, len(places)) if distance(places[i][2], places[j][2]) <= 2]
    comp = components(len(places), links)
    assert got == {p[:2]: (*places[c][:2], places[c][:2] == p[:2]) for p, c in zip(places, comp, strict=True)}
    assert len(links) > 20
    assert line_dedup.line_classes(none).count() == 0


def test_op2_long_lines_link_by_their_length(spark):
    r = random.Random(12)
    lines = [sentence(r, n) for n in (9, 10, 11, 16, 30, 34, 40, 70) for _ in range(3)]
    lines += [" ".join(lines[12:24]), "x" * 400]
    for s in lines[:]:
        for share in (0.5, 1, 1, 1.3):  # edits as far apart as they go
            t, k = list(s), max(1, round(share * len(s) / 20))
            for i in range(k):
                at = (2 * i + 1) * len(s) // (2 * k)
                t[at] = r.choice(["", "z", "zy", t[at] + "q"])
            lines.append("".join(t))
    crowd = [list(sentence(r, 40)) for _ in range(1)] * 40  # a large list
    lines += ["".join(c if r.random() > 0.02 else "z" for c in s) for s in crowd]
    r.shuffle(lines)
    lines = [s.strip() for s in lines]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.first_doc for x in line_dedup.line_classes(df).collect()}
    n = len(lines)
    near = [(i, j) for i in range(n) for j in range(i + 1, n) if abs(len(lines[i]) - len(lines[j])) < 300 and line_dedup.distance(lines[i], lines[j]) <= max(2, min(len(lines[i]), len(lines[j])) // 20)]
    assert len(near) > 100 and any(distance(lines[i], lines[j]) > 2 for i, j in near[:40])
    assert all(line_dedup.distance(a, b) == distance(a, b) for a, b in zip(lines[:12], lines[1:13]))
    assert got == dict(enumerate(components(n, near)))


def _crowd(r, n):
    """A line, copies of it that are near it and not near each other, and one that is near none."""
    base = sentence(r, 60)
    out = [base]
    for k in range(n):
        t = list(base)
        for _ in range(len(base) // 26):
            t[r.randrange(len(t))] = chr(0x4E00 + k)
        out.append("".join(t))
    return [*out, base[: len(base) // 2] + sentence(r, 30)]


def test_op2_rows_of_a_large_group_grow_with_its_lines(spark):
    r = random.Random(21)
    lines = _crowd(r, 120)
    near = [(i, j) for i in range(len(lines)) for j in range(i + 1, len(lines)) if line_dedup.links(lines[i], lines[j])]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    order = spark.sparkContext.broadcast(line_dedup.gram_order(df))
    posted = line_dedup.long_postings(df, order, 6, 60, 1 << 31).repartition(4, "bucket").sortWithinPartitions("bucket")
    maybe = line_dedup.long_links(posted, 6)
    assert maybe.count() < 64 * len(lines)  # in each of 64 buckets, one from each line but one
    got = line_dedup.joined(np.zeros(len(lines), dtype=np.int64), lines, np.array([9] + [1] * (len(lines) - 1)), order.value)
    want = components(len(lines), near)
    assert len(near) < 2 * len(lines) and len(got[0]) == len(lines) - len(set(want))
    assert components(len(lines), list(zip(*(x.tolist() for x in got), strict=True))) == want


def test_op2_groups_too_large_for_a_task(spark, monkeypatch):
    r = random.Random(22)
    lines = [s for _ in range(3) for s in _crowd(r, 8)] + [sentence(r, 7) for _ in range(6)]
    lines += [s + "z" for s in lines[-6:]] + [s[:-2] for s in lines[-6:]]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    near = [(i, j) for i in range(len(lines)) for j in range(i + 1, len(lines)) if line_dedup.links(lines[i], lines[j])]
    monkeypatch.setattr(line_dedup, "CROWD", 2)
    got = {x.doc_id: x.first_doc for x in line_dedup.line_classes(df).collect()}
    assert got == dict(enumerate(components(len(lines), near)))


def test_op2_lists_of_near_lines_do_not_hold_their_pairs():
    import tracemalloc

    n = 3000  # one list, all of it near: 4498500 pairs
    key = np.arange(n, dtype=np.int64) * 7
    cols = [np.zeros(n, dtype=np.int64), np.full(n, 100), np.full(n, 5), key, np.zeros((n, 4), dtype=np.uint64)]
    cols[4][-1] = 2**64 - 1 - np.uint64(2**63)  # but for one, which is far
    tracemalloc.start()
    u, v = line_dedup.bucket_links(cols, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert u.tolist() == [0] * (n - 2) and v.tolist() == key[1:-1].tolist()
    assert peak < 60e6  # 16 bytes for each pair are 72 MB


def test_op2_groups_are_joined_in_turns(spark, monkeypatch):
    rnd = random.Random(8)
    line = lambda n: "".join(rnd.choice("abcdefghij klmnop") for _ in range(n)).replace("  ", " x").strip()
    base = [line(rnd.choice([40, 90, 300])) for _ in range(30)]
    lines = base + [b[:k] + "#" + b[k + 1 :] for b in base for k in (3, 17)]
    order = line_dedup.gram_order(spark.createDataFrame([("\n".join(lines),)], "text string"))
    join = lambda: [c.tolist() for c in line_dedup.joined(np.zeros(len(lines), dtype=np.int64), lines, np.ones(len(lines), dtype=np.int64), order)]
    want, most, real = join(), [], line_dedup._entries
    monkeypatch.setattr(line_dedup, "TURN", 1000)
    monkeypatch.setattr(line_dedup, "_entries", lambda *a: (out := real(*a), most.append(len(out[0])))[0])
    assert join() == want and len(want[0]) == 60
    assert len(most) > 5 and max(most) < sum(most) / 3  # segments are held in parts


def test_op2_lines_joined_by_chance_are_parted(spark, monkeypatch):
    r = random.Random(23)
    lines = [sentence(r, 150) for _ in range(20)]
    lines += [s[:40] + "#" + s[41:] for s in lines]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    near = [(i, j) for i in range(len(lines)) for j in range(i + 1, len(lines)) if line_dedup.links(lines[i], lines[j])]
    order = spark.sparkContext.broadcast(line_dedup.gram_order(df))
    keys = line_dedup.Lines(lines).keys().tolist()
    one = spark.createDataFrame([(k, min(keys)) for k in keys], "node long, component long")
    most, real = [], line_dedup.joined_groups
    monkeypatch.setattr(line_dedup, "WIDE", 4, raising=False)
    monkeypatch.setattr(line_dedup, "joined_groups", lambda rows, order: most.append(rows.groupBy("group").count().agg({"count": "max"}).first()[0]) or real(rows, order))
    links, whole = line_dedup.near_links(df, 24, one, order)
    at = {k: n for n, k in enumerate(keys)}
    assert whole and most == [2]  # 40 lines met in one task before
    assert components(len(lines), [(at[x.u], at[x.v]) for x in links.df.collect()]) == components(len(lines), near)


def test_op2_long_lines_that_share_phrases_do_not_link(spark):
    r = random.Random(24)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 7))) for _ in range(40)]
    lines = [" ".join(r.choice(words) for _ in range(200))[:800] + "." for _ in range(40)]
    lines += [s[:40] + "#" + s[41:300] + "#" + s[301:] for s in lines[:5]]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    order = spark.sparkContext.broadcast(line_dedup.gram_order(df))
    posted = line_dedup.long_postings(df, order, 4, 60, 1 << 31).repartition(4, "bucket").sortWithinPartitions("bucket")
    at = {k: n for n, k in enumerate(line_dedup.Lines(lines).keys().tolist())}
    links = [(at[x.u], at[x.v]) for x in line_dedup.long_links(posted, 4).collect()]
    near = [(k, 40 + k) for k in range(5)]
    assert min(map(len, lines)) > 500 and all(line_dedup.links(lines[i], lines[j]) for i, j in near)
    assert components(len(lines), links) == components(len(lines), near)


def test_op2_small_tables_have_few_packed_rows(spark, monkeypatch):
    r = random.Random(25)
    df = spark.createDataFrame([(k, sentence(r, 40)) for k in range(60)], "doc_id long, text string").repartition(6)
    rows, real = [], line_dedup.long_postings
    monkeypatch.setattr(line_dedup, "long_postings", lambda *a: rows.append(real(*a).count()) or real(*a))
    spark.conf.set("spark.sql.shuffle.partitions", 64)  # more than six tasks of ten lines need
    try:
        assert line_dedup.line_classes(df).count() == 60
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert 0 < sum(rows) <= 6 * 16 * line_dedup.PASSES


def test_op2_short_lines_by_equality(spark, tmp_path):
    texts = ["All rights reserved.\n\n \na", "All rights reserved.\nall rights reserved.", "b\n All rights reserved. \n\nb"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {(x.doc_id, x.line_no): (x.first_doc, x.first_line, x.n_lines, x.kept) for x in line_dedup.op2_line_dedup(spark, str(tmp_path)).collect()}
    first = (0, 0, 3)
    assert got == {(0, 0): (*first, True), (0, 3): (0, 3, 1, True), (1, 0): (*first, False), (1, 1): (1, 1, 1, True), (2, 0): (2, 0, 2, True), (2, 1): (*first, False), (2, 3): (2, 0, 2, False)}
    assert {x.doc_id: x.text for x in line_dedup.line_stage(spark, df, "").collect()} == {0: texts[0], 1: "all rights reserved.", 2: "b\n"}


def test_line_stage_keeps_first_lines_and_columns(spark, docs, none):
    out = line_dedup.line_stage(spark, docs, "")
    assert out.columns == docs.columns
    got = out.collect()
    assert {x.doc_id for x in got} >= set(range(12)) and 12 not in {x.doc_id for x in got}
    assert line_dedup.line_stage(spark, none, "").count() == 0


def test_op3_layers_and_base(spark, docs, none):
    s = base64.b64encode(b"password=hunter22abc").decode()
    packed = base64.b64encode(gzip.compress(s.encode())).decode()
    for enc in (s, packed, base64.b64encode(s.encode()).decode(), "pass%77ord%3Dabcdefgh1", "pass\\u0077ord=abcdefgh"):
        base, every = secret_scan.all_spans(f"hé {enc} end")
        assert not base and len(every) == 1 and every[0][0] >= 3 and every[0][1] <= 3 + len(enc)
    base, every = secret_scan.all_spans("token=secret=abcdef AKIA" + "A" * 16 + " " + "ab12" * 6)
    assert [k for _, _, k in base] == [0, 1, 2] and every == base
    got = {x.doc_id: x for x in secret_scan.scan(docs).collect()}
    assert got[19].spans == "" and got[19].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[26].n_assign == 1
    assert secret_scan.scan(none).count() == 0
    stage = {x.doc_id: x for x in secret_scan.secret_stage(None, docs, "").collect()}
    assert "hunter2" not in stage[26].text and stage[26].n_chars == len(stage[26].text) and stage[19].text is None


def test_op3_every_occurrence():
    s = base64.b64encode(b"password=hunter22abc").decode()
    outer = base64.b64encode(f"{s} and {s}".encode()).decode()
    for encs in ((s, s), (s, "pass%77ord%3Dhunter22abc", s), (outer, s, outer)):
        text = " then ".join(encs)
        at = [text.index(encs[0]), *[text.index(e, len(encs[0])) for e in encs[1:2]]]
        got = secret_scan.all_spans(text)[1]
        assert len(got) == len(encs) and [g[0] for g in got][:2] == at
        assert all(e not in secret_scan.redact(text) for e in encs)


def test_op3_escapes_keep_their_line():
    wrapped = base64.b64encode(b'my "passwd" for it').decode()
    for line in ('"password": "h%75nter22abc"', "password = h%75nter22abc", "password: \\u0068unter22abc", '"password": "\\u0068unter22abc"', "pass%77ord = 'h\\x75nter22abc'", f"{wrapped}", f"{base64.b64encode(b'my login password').decode()} = hunter22abc"):
        text = f"first line\nhé {line}, and more\nlast"
        base, every = secret_scan.all_spans(text)
        assert not base
        if line == wrapped:
            assert not every
            continue
        assert every and all(text.index(line) <= a < b <= text.index(line) + len(line) for a, b, _ in every)
        assert "nter22abc" not in secret_scan.redact(text) and secret_scan.redact(text).endswith(", and more\nlast")


def test_op3_base64_of_both_alphabets_in_paths_and_over_lines():
    r = random.Random(4)
    for k in range(300):
        plain = f"{sentence(r, r.randint(3, 25))} password=hunter22abc {sentence(r, r.randint(0, 25))}".encode()
        data = [plain, zlib.compress(plain), gzip.compress(plain)][k % 3]
        for enc in (base64.urlsafe_b64encode(data).decode(), base64.b64encode(data).decode()):
            lines = [enc[i : i + 64] for i in range(0, len(enc), 64)]
            for form in (enc, enc.rstrip("="), f"https://example.com/cb/{enc}", f"see-also_{enc}", f"x{enc}", "\n".join(lines), "\r\n  ".join(lines), "\\n".join(lines), f"{enc.rstrip('=')}\nand more"):
                text = f"a {form} z"
                every = secret_scan.all_spans(text)[1]
                assert every, form
                # The span is the whole encoded run, or its part up to where it is readable.
                assert all(k == 0 and 2 <= a < b <= 2 + len(form) for a, b, k in every)
    two = [base64.b64encode(zlib.compress(f"{w} password=hunter22abc".encode())).decode().rstrip("=") for w in ("one", "other")]
    assert {(0, len(two[0]), 0), (len(two[0]) + 1, len("/".join(two)), 0)} <= set(secret_scan.all_spans("/".join(two))[1])
    assert secret_scan.all_spans("a well-known-and-rather-long word/and/some/path/to/a/file_name_here")[1] == []


def test_op3_partly_decodable_escapes():
    for enc in ("x%ffpass%77ord%3Dhunter22abc", "%80%80pass%77ord%3Dhunter22abc%fe", "100%pass%77ord%3Dhunter22abc%"):
        every = secret_scan.all_spans(f"é {enc} z")[1]
        assert len(every) == 1 and every[0][0] >= 2 and "hunter22" not in secret_scan.redact(f"é {enc} z")


def test_op3_random_nestings_with_repeats():
    r = random.Random(17)
    layers = [
        lambda t: base64.b64encode(t.encode()).decode(),
        lambda t: base64.urlsafe_b64encode(gzip.compress(t.encode())).decode(),
        lambda t: base64.b64encode(zlib.compress(t.encode())).decode(),
        lambda t: "".join(f"%{b:02X}" for b in t.encode()),
        lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
    ]
    for _ in range(150):
        made = []
        for _ in range(r.randint(1, 3)):
            enc = f"password=hunter{r.randint(10, 99)}abc"
            for _ in range(r.randint(1, 4)):
                enc = r.choice(layers)(enc)
            made.append(enc)
        parts = [w for _ in range(r.randint(1, 3)) for e in made for w in (sentence(r, 4), e)]
        text, places, at = " ".join(parts), [], 0
        for w in parts:
            if w in made:
                places.append((at, at + len(w)))
            at += len(w) + 1
        every = secret_scan.all_spans(text)[1]
        assert {(max(p for p in places if p[0] <= a)) for a, _, _ in every} == set(places)
        assert all(any(p[0] <= a < b <= p[1] for p in places) for a, b, _ in every)
        assert all(e not in secret_scan.redact(text) for e in made)


def test_op3_long_texts_take_linear_time():
    import time

    for t in (("abc/def-ghi_" * 80000) + "%41%zz", "a%20b" * 150000, "%41" * 250000, "token" + " " * 1000000, ("Zm9v" * 20 + "\n") * 12000, "\\u0041bc " * 60000):
        began = time.process_time()
        secret_scan.all_spans(t)
        assert time.process_time() - began < 20


def test_op3_large_layers_and_members():
    secret = b" password=hunter22abc "
    big = b"all work and no play. " * 400_000
    enc = lambda b: base64.b64encode(b).decode()
    members = gzip.compress(b"first member") + gzip.compress(secret)
    broken = zlib.compress(secret + bytes(random.Random(1).choices(b"abcdefgh ", k=4000)))[:-900]
    for data in (zlib.compress(big + secret), gzip.compress(secret + big), gzip.compress(big + secret + big), gzip.compress(big + enc(secret).encode() + b" " + big), members, gzip.compress(big) + gzip.compress(secret), broken):
        text = f"see {enc(data)} end"
        assert secret_scan.all_spans(text)[1] == [(4, len(text) - 4, 0)]
    edge = secret_scan.BLOCK - 12
    assert secret_scan.all_spans(enc(zlib.compress(b"a " * (edge // 2) + secret + big)))[1]
    assert secret_scan.all_spans(enc(zlib.compress(big)))[1] == []


def test_op4_equals_the_library(spark, docs, rows, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path(piece_coding.DEFAULT))
    p = piece_coding.Pieces(P.path(piece_coding.DEFAULT))
    r = random.Random(11)
    texts = ["".join(r.choice("abcdeéΣς'sSt 1²!?.\n\t<|>日本😀   ▁") for _ in range(r.randint(0, 60))) for _ in range(400)]
    texts += ["".join(r.choice("ethaioning") for _ in range(2500)), " " * 50, "a" * 1500, "x" + " " * 900 + "y"]
    ids = p.encode([piece_coding.normal(t) for t in texts])
    assert ids == sp.encode(texts)
    assert [p.decode(x) for x in ids] == sp.decode(ids)
    big = " ".join(t or "" for _, t, *_ in rows)
    assert p.encode([piece_coding.normal(big)])[0] == sp.encode(big)
    want = sorted((x[0] is not None, x[0] or 0, len(sp.encode(x[1] or ""))) for x in rows)
    for chunk in (piece_coding.CHUNK, 200):
        got = piece_coding.digests(docs, chunk=chunk).collect()
        assert sorted((x.doc_id is not None, x.doc_id or 0, x.n_tokens) for x in got) == want and all(x.round_trip for x in got)
    assert piece_coding.decode(piece_coding.encode(docs, chunk=200)).where("decoded <> source").count() == 0
    assert piece_coding.digests(none).count() == 0


def test_op4_chunks_cut_anywhere(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path(piece_coding.DEFAULT))
    r = random.Random(23)
    texts = ["".join(r.choice("日本語中文字一二三四五六七八九十人大小") for _ in range(30000)), "a" * 9000, " " * 4000, "日" * 700 + " ab. " + "ethaioning" * 700]
    texts += [" ".join(sentence(r, 15) for _ in range(60)), "é▁ü" * 900 + "\n\n" * 300 + "x.y,z" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for chunk in (251, 4000):
        rows = piece_coding.encode(df, chunk=chunk).collect()
        for i, t in enumerate(texts):
            parts = sorted((x for x in rows if x.doc_id == i), key=lambda x: x.chunk)
            assert [y for x in parts for y in x.ids] == sp.encode(t)
            assert len(parts) == (-(-(len(t) + 1) // chunk) if len(t) > chunk else 1) and "".join(x.source for x in parts) == t.replace("▁", " " if len(t) > chunk else "▁")
        got = {x.doc_id: x for x in piece_coding.digests(df, chunk=chunk).collect()}
        for i, t in enumerate(texts):
            assert got[i].n_tokens == len(sp.encode(t)) and got[i].ids_crc32 == zlib.crc32(np.array(sp.encode(t), dtype="<u4").tobytes())


def test_op4_forgets_and_remembers(monkeypatch):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path(piece_coding.DEFAULT))
    monkeypatch.setattr(piece_coding, "ARENA", 300)
    monkeypatch.setattr(piece_coding, "PART_SLOTS", 5)
    monkeypatch.setattr(piece_coding, "TOGETHER", 400)
    p = piece_coding.Pieces(P.path(piece_coding.DEFAULT))
    r = random.Random(3)
    texts = [" ".join(r.choice(["apple", "pear", "日本", word(r)]) for _ in range(r.randint(0, 30))) for _ in range(300)]
    assert p.encode([piece_coding.normal(t) for t in texts]) == sp.encode(texts)


def test_op5_reads_back(spark):
    r = random.Random(2)
    odd = "<|im_end|><|im_start|>assistant \\n \\ <| <\\|"
    rows = [(c, t, ["system", "user", "assistant"][t % 3] if t else "system", None if r.random() < 0.1 else odd * r.randint(0, 2) + sentence(r, r.randint(1, 500))) for c in range(6) for t in range(r.randint(1, 14))]
    rows += [(None, 0, "assistant", "no id"), (9, 0, None, "ok"), (9, 0, "assis\ntant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    windows = chat_format.format_conversations(df)
    got = {x.conv_id: x for x in chat_format.digests(windows).collect()}
    for c in {x[0] for x in rows}:
        turns = sorted(((x[1], x[2], x[3]) for x in rows if x[0] == c), key=lambda x: (x[0], x[1] or "", x[2] or ""))
        loss = "".join(x[2] or "" for x in turns if x[1] == "assistant")
        said = "".join(f"{x[1] or ''}\n{x[2] or ''}\n" for x in turns)
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    later = [w for w in windows.collect() if w.window > 0]
    assert later and all(chat_format.read_window(w.formatted)[0][0] == "system" for w in later)
    assert all(w.n_tokens <= chat_format.BUDGET or w.n_new == 1 for w in windows.collect())
    assert chat_format.digests(chat_format.format_conversations(df.limit(0))).count() == 0


def test_op6_against_brute_force(spark, docs, rows, none):
    def brute(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        seen = {k for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(seen)

    got = quality.clean_lines(docs).select("text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    for x in got:
        assert brute(x.text) == tuple(x)[1:6]
        assert x.base_failed == (x.n_words < 10 or 100 * x.n_repeat_words > 20 * x.n_words)
        assert not (x.kept and x.base_failed)
    assert len(got) == len(rows) and {x.kept for x in got if x.text in {r[1] for r in rows[:12]}} == {True}
    out = quality.quality_stage(spark, docs, "")
    assert out.columns == docs.columns and {x.kept for x in out.collect()} <= {"k", None}
    assert quality.quality_stage(spark, none, "").count() == 0
    bad = spark.createDataFrame([("Home | About | News | Contact\nGood words make a fine line here, and this one goes on with other words till its end.",), ("Home | About | News\n" * 9,)], "text string")
    assert [x.kept for x in quality.clean_lines(bad).collect()] == [True, False]


def test_op7_equals_the_library(spark, docs, rows, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path(token_count.DEFAULT))
    got = sorted((x.doc_id is not None, x.doc_id or 0, x.n_bytes, x.n_tokens, x.over_limit) for x in token_count.count_tokens(docs).collect())
    want = []
    for x in rows:
        n = len(tok.encode(x[1] or "", add_special_tokens=False).ids)
        want.append((x[0] is not None, x[0] or 0, len((x[1] or "").encode()), n, n > 2048))
    assert got == sorted(want)
    c = token_count.Counter(P.path(token_count.DEFAULT))
    r = random.Random(1)
    texts = ["".join(r.choice("abcdeéΣς'sSt 1②½!.\n<|>́İ日😀") for _ in range(r.randint(0, 40))) for _ in range(500)] + ["a<|endoftext|>b <|startoftext|>", "aaaa" * 500]
    assert c.counts(texts) == [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert token_count.count_tokens(none).count() == 0


def brute_jaccard(texts, words, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    n = len(texts)
    links = [(i, j) for i in range(n) for j in range(i + 1, n) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return sets, components(n, links), links


def test_op8_against_all_pairs(spark, docs, rows, none):
    r = random.Random(21)
    base = sentence(r, 90).split()
    copies = []
    for _ in range(70):  # a large group of near copies of one text
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = word(r)
        copies.append(" ".join(w))
    texts = copies + [x[1] for x in rows if x[0] is not None][:-1]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {x.doc_id: x for x in jaccard_join.jaccard_components(df).collect()}
    sets, comp, links = brute_jaccard(texts, 4, 85)
    assert len(links) > 100
    for i in range(len(texts)):
        assert (got[i].n_shingles, got[i].component_id) == (len(sets[i]), comp[i])
    out = jaccard_join.jaccard_stage(spark, docs, "")
    assert out.columns == docs.columns and 12 not in {x.doc_id for x in out.collect()}
    assert jaccard_join.jaccard_components(none).count() == 0


def test_jaccard_stage_keeps_one_row_of_each_group(spark):
    r = random.Random(31)
    a, b, c, d = (sentence(r, 60) for _ in range(4))
    near = a.replace(a.split()[30], "changed", 1)
    rows = [(5, a, "x"), (5, a, "y"), (2, near, "x"), (7, a, "x"), (7, b, "x"), (None, c, "x"), (None, c, "y"), (None, a, "x"), (3, d, "x"), (None, d, "x"), (4, None, "x"), (4, None, "x"), (None, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    got = jaccard_join.jaccard_stage(spark, df, "")
    assert got.columns == df.columns
    got = [tuple(x) for x in got.collect()]
    assert Counter(x[:2] for x in got) == Counter([(2, near), (7, b), (None, c), (3, d), (4, None), (4, None), (None, "")])
    assert (None, c, "x") in got


def test_op9_packs_all(spark, docs, rows, none):
    from tokenizers import Tokenizer
    import zlib

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = packing.packing_stage(spark, docs, "").collect()
    by = Counter()
    for x in rows:
        ids = np.array([*tok.encode(x[1] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for p, (s, n) in enumerate(packing.cut(len(ids), 2048)):
            by[x[0], p, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == by
    seqs = {}
    for x in got:
        seqs.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for places in seqs.values():
        end = 0
        for o, n in sorted(places):
            assert o == end
            end += n
        assert end <= 2048
    assert len(seqs) <= -(-sum(x.length for x in got) // 2048) + 1
    assert packing.packing_stage(spark, none, "").count() == 0


def test_op9_ids_are_those_of_the_library():
    from tokenizers import Tokenizer

    tok, enc = Tokenizer.from_file(P.path("byte_bpe_50k.json")), packing.encoder(P.path(packing.DEFAULT))
    r = random.Random(8)
    texts = ["".join(r.choice("abcdeéΣς'sSt 1²!?.\n\t<|>日本😀   ▁\r\x00\u200b") for _ in range(r.randint(0, 60))) for _ in range(600)]
    texts += ["a<|endoftext|>b", "<|endoftext|><|endoftext|>", " <|endoftext|> ", "<|endoftext", "x" * 5000, " " * 3000, "\n" * 500, "I'LL we'll 'S 123456789 ٣٤"]
    assert [packing.encode(enc, t).tolist() for t in texts] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_op9_many_salts_and_clashing_names(spark):
    rows = [(i, i % 7, 0, 1 + i * i % 2047, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, _salt0 int, _rank0 int, length long, _n0 long").repartition(5)
    got = packing.pack(df, salts=200).collect()
    assert sorted(tuple(x)[:5] for x in got) == rows
    seqs = {}
    for x in got:
        seqs.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for places in seqs.values():
        places.sort()
        assert all(o == sum(n for _, n in places[:k]) for k, (o, _) in enumerate(places)) and sum(n for _, n in places) <= 2048


def test_plan_is_tight():
    r = random.Random(3)
    h = Counter(r.randint(20, 2047) for _ in range(30000))
    plan = packing.plan(h)
    assert plan.by_best_fit < 100 < plan.by_configuration  # large pieces go by the program's configurations
    used = Counter()
    for length, _, count, *_ in plan.runs:
        used[length] += count
    assert used == h and plan.n * 2048 <= 1.01 * sum(k * v for k, v in h.items())


def test_op10_learns_and_names(spark, none, sf_dir):
    got = language_id.op10_language_id(spark, sf_dir).collect()
    lang = {x.doc_id: x.lang for x in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    held = [x for x in got if x.held_out]
    assert len(got) == len(lang) and np.mean([x.lang_pred == lang[x.doc_id] for x in held]) > 0.95
    model = language_id.fit(language_id.features(["abc abc", "xyz xyz"]), ["a", "b"])
    assert model.predict([None, "", "123 !", "abc abc abc"])[0] == ["und", "und", "und", "a"]
    assert language_id.identify(none, language_id.train(none)).count() == 0
    # Rows that repeat an id cannot make the sample grow, and give the same model in any order.
    rows = [(k % 40, ("abc abc " if k % 2 else "xyz xyz ") + "q" * (k // 80), "a" if k % 2 else "b") for k in range(4000)]
    many = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, two = (language_id.train(many.repartition(n), sample=20) for n in (1, 5))
    assert one.langs == ["a", "b"] and (one.weights == two.weights).all()


def test_pipeline_stages_in_order(spark):
    import corpus_pipeline

    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "secret_scans", "best_fit_packing"]
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 50
