"""The ten operators on small fixtures: brute force, round trips, held-out accuracy, and awkward rows."""

import gzip
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA, same
from verdure.llm import op1_hmm, op2_rlz, op3_pii, op4_omh, op5_warc, op6_urls, op7_rabitq, op8_curriculum, op9_decontam, op10_crf, queries

SPLIT = re.compile(r"[^\x20\x09-\x0d]+")
LONG = " ".join(f"w{i * 7919 % 1009}" for i in range(3000))
AWKWARD = [(1, None, "a"), (2, "", "a"), (3, "  \n\t ", None), (4, "One two three.", "b"), (4, "One two three.", "b"), (None, "no id here", "b"), (5, LONG, "c"), (6, LONG + " x", "c"), (7, "é ü ß " * 30, "a")]
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA).withColumn("score", F.lit("clash")).withColumn("kind", F.lit(1)).withColumn("base", F.lit(2))


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    assert same((tuple(r) for r in df.select(*columns).collect()), duck.sql(queries.oracle_sql()[name]), columns)


def test_hmm_base_and_forward(spark, documents):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {i: [*SPLIT.findall((t or "").translate(low)), None] for i, t in documents}
    counts = Counter(x for i, ts in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for x in ts)
    n, v = sum(counts.values()), len(counts)
    rows = queries.queries()["op1_hmm_score"](spark, DATA).collect()
    assert len(rows) == len(documents)
    for r in rows:
        ts = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ts), sum(counts[x] > 0 for x in ts), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in ts))
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_hmm_forward_against_all_paths():
    rng = np.random.default_rng(1)
    emit, move, begin = rng.dirichlet(np.ones(4), 2).T, rng.dirichlet(np.ones(2), 2), rng.dirichlet(np.ones(2))
    seq = np.array([0, 3, 1, 2, 0], np.int32)
    total = 0.0
    for path in range(2 ** len(seq)):
        s = [path >> i & 1 for i in range(len(seq))]
        p = begin[s[0]] * emit[seq[0], s[0]]
        for a, b, x in zip(s, s[1:], seq[1:], strict=False):
            p *= move[a, b] * emit[x, b]
        total += p
    model = (emit, move, begin)
    got, counts, moves, starts = op1_hmm.forward(model, np.concatenate([seq, seq[:2]]), np.array([0, 5]), np.array([5, 2]), back=True)
    assert got[0] == pytest.approx(math.log(total), rel=1e-12)
    assert counts.sum() == pytest.approx(7) and moves.sum() == pytest.approx(5) and starts.sum() == pytest.approx(2)


def test_substring_dedup_against_brute_force(spark, documents):
    docs = [*documents, (10_001, LONG), (10_002, "x " + LONG[:2000]), (10_003, None), (10_004, LONG)]
    words, first = {i: SPLIT.findall(t or "") for i, t in docs}, {}
    for i in sorted(words):
        for j in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][j : j + 13]), i)
    got = {r.doc_id: r for r in op2_rlz.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, w in words.items():
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < i:
                gone[j : j + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256, got[i].kept) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def holds(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "card":
        total = sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(d)))
        return 16 <= len(d) <= 19 and total % 10 == 0
    return kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.split(".")) or kind == "phone" and 8 <= len(d) <= 15


def test_base_spans_against_brute_force(spark, documents):
    made = ["a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4", "+1 (555) 555-0100, +12 3 +1234567890123456", "4111 1111-1111 1111 é 4111111111111112", "é@x.y ü.ö@a.b +", "1" * 5000, "a" * 5000 + "@", "9.9.9.9 " * 300]
    docs = [*documents, *enumerate([*made, None, ""], 100_000)]
    for r in op3_pii.personal_data(spark.createDataFrame(docs, "doc_id long, text string"), model=([], 0.0, [])).select("doc_id", "base", "spans").collect():
        text = dict(docs)[r.doc_id] or ""
        want = [(i, m.start(), m.end()) for i, k in enumerate(PATTERNS) for m in re.finditer(PATTERNS[k], text) if holds(k, m[0])]
        assert [tuple(x) for x in r.base] == want
        assert set(want) <= {tuple(x) for x in r.spans}


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é mail a@b.co and 10.0.0.1.", "x"), (2, None, "y")], "doc_id long, text string, base string")
    got = {r.doc_id: r for r in op3_pii.redacted(df, model=([], 0.0, [])).collect()}
    assert got[1].text == "é mail [EMAIL] and [IP]." and got[2].text is None and got[1].base == "x"


def test_boosting_separates():
    table = [((g, n, 0, 0, 0, 0, 0, 0, 0), [50 * (n > 5), 50 * (n <= 5), 40 * (n > 5), 40 * (n <= 5)]) for g in range(3) for n in range(10)]
    trees, bias = op3_pii.boost(table)
    scores = [bias + sum(op3_pii.value(t, f) for t in trees) for f, _ in table]
    cut = op3_pii.calibrated(table, trees, bias)
    assert all((s >= cut - 1e-9) == (f[1] > 5) for s, (f, _) in zip(scores, table, strict=True))


def test_near_duplicates(spark):
    rng = np.random.default_rng(2)
    base = [[f"v{x}" for x in rng.integers(0, 5000, 120)] for _ in range(8)]
    docs = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i, w in enumerate(base):
        e = list(w)
        e[10] = e[70] = "changed"
        docs += [(100 + i, " ".join(e)), (200 + i, " ".join(w)), (300 + i, " ".join(w[60:] + w[:60]))]  # near, equal, turned round
    docs += [(900, None), (901, ""), (902, "a b"), (903, "a b"), (904, "a c")]
    got = {r.doc_id: r.class_id for r in op4_omh.near_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i in range(8):
        assert got[i] == got[100 + i] == got[200 + i] == i and got[300 + i] == 300 + i
    assert (got[900], got[901], got[902], got[903], got[904]) == (900, 901, 902, 902, 904)


def test_near_short_texts_against_brute_force(spark):
    rng = np.random.default_rng(12)
    texts = []
    for n in [*range(4, 26), 32, 40, 51, 64] * 3:
        w = [f"v{x}" for x in rng.integers(0, 3000, n)]
        texts.append(w)
        for _ in range(2):
            e = list(w)
            for _ in range(int(rng.integers(1, n // 5 + 2))):
                i, how = int(rng.integers(0, len(e))), rng.integers(0, 3)
                e[i : i + 1] = [["new"], [], [e[i], f"v{rng.integers(0, 3000)}"]][how]
            texts.append(e)
    texts = [w[:64] for w in texts]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = list(range(len(texts)))
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:i]):
            most = int(0.2 * max(len(a), len(b)) + 1e-9)
            if abs(len(a) - len(b)) <= most and len(set(a) & set(b)) * 2 >= min(len(set(a)), len(set(b))) and distance(a, b) <= most:
                x, y = sorted((want[i], want[j]))
                want = [x if k == y else k for k in want]
    got = {r.doc_id: r.class_id for r in op4_omh.near_classes(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")).collect()}
    assert got == dict(enumerate(want)) and len(set(want)) < len(want)


def test_near_duplicates_of_equal_and_null_ids(spark):
    a, b, x = (" ".join(f"{k}{i}" for i in range(60)) for k in "abx")
    docs = [(1, a), (1, x), (2, b + " more"), (None, b), (None, a + " more"), (None, "all alone here")]
    got = Counter((r.doc_id, r.class_id, r.copy_of) for r in op4_omh.near_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == Counter([(1, 1, 1), (1, 1, 1), (2, 2, 2), (None, 2, None), (None, 1, None), (None, None, None)])


def test_edit_distances_against_plain():
    rng = np.random.default_rng(4)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    a = [rng.integers(2, 9, n).astype(np.uint64) for n in rng.integers(1, 60, 60)]
    b = [np.delete(x, slice(0, len(x), 5)) if i % 2 else rng.integers(2, 9, rng.integers(1, 60)).astype(np.uint64) for i, x in enumerate(a)]
    most = np.array([max(len(x), len(y)) // 3 for x, y in zip(a, b, strict=True)])
    for x, y, m, d in zip(a, b, most, op4_omh.edit_distances(a, b, most), strict=True):
        true = plain(x.tolist(), y.tolist())
        assert d == true if true <= m else m < d <= true


def test_warc_round_trip_and_salvage(spark, tmp_path):
    html = ["a" * 2000, "a" * 2000, None, "WARC/1.0\r\nfake", "ü" * 700, "ü" * 700]
    pages = spark.createDataFrame([(i, f"http://x/%{i}\r\n", h, "z") for i, h in enumerate(html)], "page_id long, url string, html string, digest string")
    op5_warc.write_archives(pages.coalesce(1), str(tmp_path / "w"), compression="none")
    rows = {r.record_id: r for r in op5_warc.read_archives(spark, str(tmp_path / "w")).filter("kind = 'record'").collect()}
    kinds = [rows[f"<urn:page:{i}>"].warc_type for i in range(6)]
    assert kinds == ["revisit", "response", "response", "response", "revisit", "response"]
    assert all(bytes(rows[f"<urn:page:{i}>"].payload).decode() == (html[i] or "") for i in (1, 2, 3, 5))
    data = next((tmp_path / "w").rglob("part*.txt")).read_bytes()
    starts = [m.start() for m in re.finditer(rb"WARC/1\.0\r\nWARC-Type", data)]
    broken = bytearray(data)
    broken[starts[2] - 5] ^= 1  # the last byte of the second record's block
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.warc").write_bytes(b"junk" + bytes(broken) + b"WARC/1.0\r\ncut")
    got = op5_warc.read_archives(spark, str(tmp_path / "b")).orderBy("offset").collect()
    assert [r.kind for r in got].count("record") == 5 and [(r.kind, r.reason) for r in got][0] == ("gap", "no version line") and sum(r.length for r in got) == len(broken) + 17


def test_warc_members(tmp_path):
    record = lambda i: b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <%d>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" % i
    parts = [gzip.compress(record(i)) for i in range(4)]
    damaged = parts[1][:20] + b"\xff" * 12 + parts[1][32:]
    got = list(op5_warc._rows("f", parts[0] + damaged + b"noise" + parts[2] + parts[3][:-6], True))
    assert [r[7] for r in got if r[1] == "record" and r[7] in ("<0>", "<2>")] == ["<0>", "<2>"]
    gaps = [(r[2] + r[3], r[4]) for r in got if r[1] == "gap"]
    assert gaps[0] == (len(parts[0]), len(damaged) + 5) and len(gaps) == 2


def test_warc_damaged_heads_and_mixed_files():
    record = lambda i: b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <%d>\r\nContent-Length: 6000\r\n\r\n%s\r\n\r\n" % (i, np.random.default_rng(i).bytes(6000))
    parts = [gzip.compress(record(i)) for i in range(4)]
    ids = lambda data: [r[7] for r in op5_warc._rows("f", data, True) if r[1] == "record"]
    gaps = lambda data: [(r[2] + r[3], r[4]) for r in op5_warc._rows("f", data, True) if r[1] == "gap"]
    headless = b"\0" + b"".join(parts)[1:]  # the first magic is damaged, the next member begins after byte 4096
    assert ids(headless)[-3:] == ["<1>", "<2>", "<3>"] and gaps(headless)[0][0] == 0
    plain = b"junk\x1f\x8b\x08junk" + record(0) + record(1)
    assert ids(plain) == ["<0>", "<1>"] and gaps(plain) == [(0, 11)]
    mixed = record(0) + parts[1] + b"x" + record(2) + parts[3]
    assert ids(mixed) == ["<0>", "<1>", "<2>", "<3>"] and [n for _, n in gaps(mixed)] == [1]
    nested = b"WARC/1.0\r\nWARC-Record-ID: <n>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(parts[0]), parts[0])
    assert ids(nested + record(2)) == ["<n>", "<2>"] and not gaps(nested + record(2))


def test_warc_own_archives_are_salvaged(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"{i} page " * 300) for i in range(40)], "page_id long, url string, html string")
    op5_warc.write_archives(pages.coalesce(1), str(tmp_path / "w"))
    data = bytearray(next((tmp_path / "w").rglob("part*.txt")).read_bytes())
    whole = list(op5_warc._rows("f", bytes(data), True))
    assert [r[1] for r in whole] == ["record"] * 40 and len({r[2] for r in whole}) == 40
    at = whole[10][2]
    data[at + 20 : at + 60] = b"\xff" * 40
    got = list(op5_warc._rows("f", bytes(data), True))
    assert {r[7] for r in got if r[1] == "record"} >= {r[7] for i, r in enumerate(whole) if i != 10} and [(r[2] + r[3], r[4]) for r in got if r[1] == "gap"] == [(at, whole[11][2] - at)]


def test_url_rules(spark):
    rules = spark.createDataFrame(op6_urls.RULES, "verdict string, host string, path string")
    urls = ["http://A.Example.COM/en/7x?q", "http://b.com/en/", "http://com/en", "http://xcom/en/", None, "no scheme", "http://example.net/de/8#f", "http://q.org/es/1", "http://" + "a." * 3000 + "org/es/"]
    got = [(r.rule, r.verdict) for r in op6_urls.url_verdicts(spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)], "page_id int, url string, prefix string"), rules).orderBy("page_id").collect()]
    assert got == [("example.com/en/7", "allow"), ("com/en/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("example.net/de/8", "block"), ("org/es/", "block"), ("org/es/", "block")]


def test_nearest_recall(spark):
    x = np.random.default_rng(6).normal(size=(3000, 32))
    rows = [(i, list(map(float, v))) for i, v in enumerate(x)] + [(5001, None), (5002, [0.0] * 32), (5003, [float("nan")] * 32), (5020, [1.0, 2.0])]
    vectors, d = op7_rabitq.valid(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    index = op7_rabitq.build_index(vectors, d)
    got = op7_rabitq.search(index, index.filter("id % 50 = 0").select("id", "vector"), k=10).collect()
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    hits = sum(r.id in set(np.argsort(-s[r.query])[:10]) for r in got)
    assert d == 32 and len(got) == 600 and hits >= 0.99 * 600


def test_curriculum_order(spark, awkward):
    mixed = op8_curriculum.curriculum(awkward)
    rows = mixed.collect()
    assert len(rows) == len(AWKWARD) and all(r.taken <= 2 * r.size for r in rows)
    assert sum({(r.source): r.target for r in rows}.values()) == pytest.approx(1.5 * sum(r.size for r in rows))
    order = [r.position for r in op8_curriculum.training_order(awkward, mixed).collect()]
    assert order == sorted(order) and all(0 <= p <= 1 for p in order)


def test_leaks(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join(chr(97 + x) for x in rng.integers(0, 26, 5))
    items = [(i, " ".join(word() for _ in range(30)) + ". " + " ".join(word() for _ in range(8)) + ".") for i in range(30)]
    noise = lambda n: " ".join(word() for _ in range(n))
    docs = [(i, f"{noise(int(rng.integers(0, 300)))} {t.upper() if i % 2 else t} {noise(200)}") for i, t in items]
    docs += [(100 + i, noise(150) + " " + t.split(". ")[0]) for i, t in items]  # the question alone
    docs += [(300, None), (301, ""), (302, items[3][1])]
    got = {(r.doc_id, r.item_id) for r in op9_decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (98, None), (99, "")], "item_id long, text string")).collect()}
    assert got == {(i, i) for i in range(30)} | {(302, 3)}


def test_leaks_with_edits(spark):
    rng = np.random.default_rng(9)
    word = lambda: "".join(chr(97 + x) for x in rng.integers(0, 26, 5))
    noise = lambda n: [word() for _ in range(n)]
    items, docs, want = [], [], set()
    for i, (q, a) in enumerate([(35, 10), (14, 6), (13, 3), (20, 12), (40, 19)]):
        question, answer = noise(q), noise(a)
        items.append((i, " ".join(question) + ". " + " ".join(answer) + "."))
        one = [question, [*answer[:1], "changed", *answer[2:]]]  # a word of the answer
        two = [[*question[:6], "changed", *question[7:]], [*answer[: a // 2], "put", *answer[a // 2 :]]]  # a word in each part
        for k, (x, y) in enumerate((one, two)):
            docs.append((10 * i + k, " ".join([*noise(int(rng.integers(0, 200))), *x]) + ". " + " ".join([*y, *noise(90)])))
            want.add((10 * i + k, i))
        docs.append((10 * i + 5, " ".join([*question, *noise(150)])))  # the question alone: no leak unless it is OVERLAP of the item's shingles
        if q - 4 >= 0.8 * (q + a - 4):
            want.add((10 * i + 5, i))
        docs.append((10 * i + 6, " ".join([*answer, *noise(150)])))
    got = {(r.doc_id, r.item_id) for r in op9_decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want


def test_quality_held_out(spark):
    data = DATA.replace("sf0.001", "sf0.01")  # enough labels to learn from
    rows = queries.queries()["op10_quality"](spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)


def test_chain_marginals_against_all_paths():
    score, move = np.array([0.3, -1.0, 2.0]), np.array([[0.5, -0.2], [0.1, 0.4]])
    weight, good = 0.0, np.zeros(3)
    for path in range(8):
        s = [path >> i & 1 for i in range(3)]
        w = math.exp(sum(x * y for x, y in zip(score, s, strict=True)) + move[s[0], s[1]] + move[s[1], s[2]])
        weight += w
        good += w * np.array(s)
    assert op10_crf.marginals(score, np.zeros(3, int), move)[0] == pytest.approx(good / weight)


def test_awkward_rows(spark, awkward):
    n = len(AWKWARD)
    assert op1_hmm.hmm_score(awkward).count() == n
    assert op2_rlz.deduplicated(awkward).count() == n
    assert op3_pii.redacted(awkward).count() == n and op3_pii.redacted(awkward).columns == awkward.columns
    assert op4_omh.near_classes(awkward).count() == n
    labels = spark.createDataFrame([(4, 1), (5, 0)], "doc_id long, quality int")
    assert op10_crf.quality_scores(awkward, labels).count() == n
    assert op9_decontam.leaks(awkward, spark.createDataFrame([(1, "One two three.")], "item_id int, text string")).count() == 2


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for out in (op1_hmm.hmm_score(docs), op2_rlz.deduplicated(docs), op3_pii.redacted(docs), op4_omh.near_classes(docs), op8_curriculum.curriculum(docs), op10_crf.quality_scores(docs, labels), op9_decontam.leaks(docs, spark.createDataFrame([], "item_id int, text string"))):
        assert out.count() == 0
    vectors, d = op7_rabitq.valid(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id", "embedding")
    assert d == 0 and vectors.count() == 0


def test_pipeline(spark):
    import corpus_pipeline as p

    assert len(p.STAGES) == 5
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = p.run(spark, DATA).collect()
    kept = {r.doc_id for r in rows}
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert kept and not any(t in texts[i] for i in kept for t in items)
    assert len({texts[i] for i in kept}) == len(kept)
    assert not any(re.search(PATTERNS["email"], r.text) for r in rows)
    data = DATA.replace("sf0.001", "sf0.01")  # enough labels to learn from
    bad = {r.doc_id for r in spark.read.parquet(f"{data}/labels.parquet").filter("quality = 0").collect()}
    left = {r.doc_id for r in p.quality(spark, spark.read.parquet(f"{data}/documents.parquet"), data).select("doc_id").collect()}
    assert len(bad & left) <= 0.1 * len(bad)


@pytest.fixture(scope="module")
def null_and_equal_ids(spark):
    a, b, x, y = (" ".join(f"{k}{i}" for i in range(40)) for k in "abxy")
    return (a, b, x, y), spark.createDataFrame([(None, a, "s"), (None, b, "s"), (None, b, "s"), (1, x, "s"), (1, y, "s"), (2, x, "s"), (None, x + " more", "s")], SCHEMA)


def test_pipeline_near_duplicates_of_null_and_equal_ids(spark, null_and_equal_ids):
    import corpus_pipeline as p

    (a, b, x, y), docs = null_and_equal_ids
    out = p.near_duplicates(spark, docs, None)
    assert out.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter([(None, a), (None, b), (1, x), (1, y)])


def test_pipeline_leaks_of_null_and_equal_ids(spark, null_and_equal_ids, tmp_path):
    import corpus_pipeline as p

    (a, b, x, y), docs = null_and_equal_ids
    spark.createDataFrame([(1, b), (2, x)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = p.benchmark_leaks(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter([(None, a), (1, y)])
