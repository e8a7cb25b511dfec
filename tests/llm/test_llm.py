"""The training-data operators against brute force, exact round trips and held-out accuracy."""

import base64
import hashlib
import random
import re
import time
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from stemma.llm import bpe, common, decontaminate, fingerprints, langid, licenses, linededup, neardup, quality, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
FOLD = {i: i + 32 for i in range(65, 91)}


def docs(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and an extra column with a clashing name."""
    rows = [(1, None, None, None, None, "a"), (None, "some text of no id", "en", "s", 18, "b"), (2, "", "en", "s", 0, None), (3, "word " * 30000, "en", "s", 150000, "c"), (4, "same same", "en", "s", 9, "d"), (4, "same same", "en", "s", 9, "d"), (5, " \n\t ", "de", "s", 4, "e")]
    return spark.createDataFrame(rows, DOCS + ", hash string")


# ---------------------------------------------------------------- 1


def _tiktoken():
    import public_tokenizers as p
    import tiktoken

    path = p.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, p.PATTERN, tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken():
    path, pattern, reference = _tiktoken()
    assert pattern == bpe.KNOWN_PATTERN
    rng = random.Random(2)
    texts = ["", " ", "it's we'll 'same ''s a 's\n's x're", "'", "a'", "'re", "\x1ca b", " x", "a  b", "a\n\n b", "<|endoftext|>", "日本語", "é" * 90, "a" * 700, " " * 300 + "x", "\t\n ", "🎉🎉 x"]
    texts += ["".join(rng.choice("abcé日 \n'sT1!re²\x85") for _ in range(rng.randint(0, 300))) for _ in range(300)]
    e = bpe.Encoder(path, pattern)
    for text, ids in zip(texts, e.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)
        assert e.decode(ids) == text.encode()
    other = bpe.Encoder(path, r"\S+|\s+")  # any other pattern goes through the regex engine
    assert other.decode(other.encode(["a b  c"])[0]) == b"a b  c"


def test_bpe_frame(spark):
    path, pattern, reference = _tiktoken()
    got = bpe.encode_documents(odd(spark), path, pattern, keep=("doc_id", "text", "hash"), ids=True).collect()
    assert len(got) == 7
    for r in got:
        ids = reference.encode_ordinary(r.text or "")
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    back = bpe.decode_ids(bpe.encode_documents(docs(spark, ["héllo wörld"]), path, pattern, ids=True), path)
    assert back.first().text == "héllo wörld"
    assert bpe.encode_documents(docs(spark, []), path, pattern).count() == 0


# ---------------------------------------------------------------- 2


def test_loser_tree():
    rng = random.Random(1)
    for _ in range(200):
        runs = [sorted((rng.randint(0, 9), rng.random()) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 9))]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_warc_round_trip(spark):
    big = "x" * 1200
    rows = [(1, "http://a.com/x", big), (2, "http://www.A.com:80/x#f", big), (3, None, None), (4, "", "q"), (5, "http://b.com/?q=1", "q"), (6, "http://b.com", big + "\r\n\r\nWARC/1.1\r\n"), (7, "https://sub.b.com/é é", "naïve")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r for r in warc.archive_pages(pages).collect()}
    assert len(got) == 7
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert got[1].record_type == "revisit" and got[1].refers_to == 2 and got[2].record_type == "response"
    assert got[4].record_type == got[5].record_type == "response"
    assert got[1].urlkey == got[2].urlkey == "com,a)/x"
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_index_is_in_order(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.org/{('hot', '/a b', '/a!b', i)[i % 4]}", f"p{i}") for i in range(300)], "page_id long, url string, html string").repartition(5)
    path = common.shared_path(spark, "t")
    warc.write_archives(pages, path)
    merged = warc.merge_index(warc.read_archives(spark, path), rows_per_range=7).orderBy("range", "place").collect()
    keys = [(r.urlkey.encode(), r.ts, r.page_id) for r in merged]
    assert keys == sorted(keys) and len(keys) == 300 and len({r.range for r in merged}) > 20
    seen = {}
    for r in merged:
        assert r.history_no == len(seen.setdefault(r.urlkey, [])) + 1
        assert r.previous_page_id == (seen[r.urlkey][-1] if seen[r.urlkey] else None)
        seen[r.urlkey].append(r.page_id)


def test_warc_of_odd_rows(spark):
    big, other = "x" * 1200, "y" * 1300
    rows = [(5, "http://a.org/", big), (5, "http://a.org/", other), (5, "http://a.org/", "small"), (7, "http://a.org/", big), (8, None, big), (None, "http://b.org/", big), (8, None, big)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in warc.archive_pages(pages).collect())
    assert got == [(0, 1200, "response", 0), (5, 5, "response", 0), (5, 1200, "revisit", 8), (5, 1300, "response", 0), (7, 1200, "revisit", 8), (8, 1200, "response", 0), (8, 1200, "response", 0)]


def test_warc_dates_in_any_time_zone(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "http://a.org/", "p"), (1730000000 - warc.EPOCH, "http://a.org/", "q")], "page_id long, url string, html string")
    monkeypatch.setattr(warc, "LARGE_BYTES", 0)  # and in archives of their own
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert sorted(r.ts for r in warc.archive_pages(pages).collect()) == [warc.EPOCH + 1, 1730000000]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


# ---------------------------------------------------------------- 3


def test_lines_that_recur(spark):
    rng = random.Random(3)
    own = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(12))
    texts = [f"{own()}\nPosted by user {i} on page {i * 7} of our site\n{own()}" for i in range(8)]
    copy = f"{own()}\n{own()}\n{own()}"
    texts += [copy] * 5 + [None, "", "alone"]
    got = {r.doc_id: r for r in linededup.drop_recurring_lines(docs(spark, texts)).collect()}
    assert got[0].n_dropped == 0 and all(got[i].n_dropped == 1 and "Posted" not in got[i].text for i in range(1, 8))
    assert all(got[i].text == copy for i in range(8, 13))  # copies are another stage's work
    assert got[13].text is None and got[14].text == "" and got[15].text == "alone"
    assert all(r.n_chars == len(r.text) for r in got.values() if r.text is not None)


def test_lines_join_their_seed(spark):
    rng = random.Random(5)
    own = lambda: "".join(rng.choice("abcdefghij") for _ in range(30))
    names = ["anna", "bert", "carl", "dora", "emil"]
    texts = [f"{own()}\nthis fine page was kindly written for you today by {names[i % 5]} and friends\n{own()}" for i in range(10)]
    got = linededup.drop_recurring_lines(docs(spark, texts)).collect()
    assert sum(r.n_dropped for r in got) == 9


def _own(rng, n=12):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def test_passages_of_several_lines(spark):
    rng = random.Random(12)
    footer = "\n".join(_own(rng, 4) for _ in range(4))
    texts = [f"{_own(rng)}\n{_own(rng)}\n{footer}" for _ in range(50)]
    got = linededup.drop_recurring_lines(docs(spark, texts)).collect()
    assert sum(r.n_dropped for r in got) == 196 and {r.n_dropped for r in got} == {0, 4}


def test_families_of_a_leaf(spark):
    """Two families of lines begin alike; each is a template, though the lines of one are commoner."""
    rng = random.Random(13)
    names = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(40)]
    first = [f"this page was kindly written for you today by {names[i]} and friends" for i in range(20)]
    other = [f"this page was once put into other words after {names[20 + i]} left us" for i in range(20)]
    assert len({len(x.split()) for x in first + other}) == 1
    texts = [f"{_own(rng)}\n{line}\n{_own(rng)}" for line in [*first, *first[:1] * 5, *other]]
    got = linededup.drop_recurring_lines(docs(spark, texts)).collect()
    assert sum(r.n_dropped for r in got) == 24 + 19


def test_copies_stay_copies(spark):
    rng = random.Random(14)
    footer = _own(rng, 8)
    base = [_own(rng) for _ in range(12)]
    near = []
    for _ in range(9):  # near copies: no line of theirs goes but the footer
        one = list(base)
        one[rng.randrange(12)] = _own(rng)
        near.append("\n".join([*one, footer]))
    texts = [f"{_own(rng)}\n{_own(rng)}\n{footer}" for _ in range(5)] + near + [near[0]] * 3
    got = sorted(linededup.drop_recurring_lines(docs(spark, texts)).collect())
    assert [r.n_dropped for r in got] == [0] + [1] * 16
    assert len({r.text for r in got[13:]} | {got[5].text}) == len({got[5].text, got[13].text})
    exact = [f"{_own(rng)}\n{footer}"]
    got = sorted(linededup.drop_recurring_lines(docs(spark, exact * 3 + [f"{_own(rng)}\n{footer}" for _ in range(4)])).collect())
    assert [r.n_dropped for r in got] == [0, 0, 0, 1, 1, 1, 1]


def test_line_report_of_odd_rows(spark):
    assert linededup.line_report(odd(spark)).count() == 7
    assert linededup.drop_recurring_lines(odd(spark)).columns == [*odd(spark).columns, "n_lines", "n_dropped"]
    assert linededup.line_report(docs(spark, [])).count() == 0
    clash = odd(spark).withColumns({k: F.lit("mine") for k in ("row_id", "n_lines", "row", "drop", "copy")})
    got = linededup.drop_recurring_lines(clash)
    assert got.columns == [*(c for c in clash.columns if c != "n_lines"), "n_lines", "n_dropped"] and {r.row_id for r in got.collect()} == {"mine"}
    assert sorted(map(str, linededup.drop_recurring_lines(clash, counts=False).collect())) == sorted(map(str, clash.collect()))


# ---------------------------------------------------------------- 4


def _shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def _components(texts):
    sets = [_shingles(t) for t in texts]
    to = list(range(len(texts)))

    def root(x):
        while to[x] != x:
            x = to[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((root(a), root(b)))
            to[b] = a
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", " \n ", "one", "One", "two words", "a b c d", "a b c d e", "A B c d e"]
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 150))]
        for _ in range(rng.randint(1, 12)):
            edited = list(base)
            for _ in range(rng.randint(0, 8)):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            texts.append(" ".join(edited))
            if rng.random() < 0.3:
                base = edited  # chains of versions
    rng.shuffle(texts)
    got = sorted(neardup.near_duplicates(docs(spark, texts)).collect())
    assert [(r.n_shingles, r.component_id) for r in got] == _components(texts)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_links_behind_hubs(spark):
    """A group without its base: members are alike in pairs, never with the hub."""
    rng = random.Random(7)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for k in range(6):
        half = list(base)
        for i in rng.sample(range(120), 10):
            half[i] = f"g{k}_{i}"
        for _ in range(3):
            one = list(half)
            one[rng.randrange(120)] = f"x{rng.random()}"
            texts.append(" ".join(one))
    got = sorted(neardup.near_duplicates(docs(spark, texts)).collect())
    assert [(r.n_shingles, r.component_id) for r in got] == _components(texts)


def test_links_in_buckets_of_unlike_hubs(spark, monkeypatch):
    """Two alike documents share buckets only where a heavier document, like neither of them, is the hub."""
    rng = random.Random(11)
    own = lambda n: [f"w{rng.random()}" for _ in range(n)]
    x, heavy, other = own(200), own(200), own(200)
    y = x[:190] + own(10)
    heavy[:60] = x[:60]
    copies = [heavy[:199] + own(1) for _ in range(4)]
    texts = [" ".join(t) for t in (x, y, *copies, other)]
    assert all(len(_shingles(texts[i]) & _shingles(texts[j])) < 0.5 * len(_shingles(texts[i]) | _shingles(texts[j])) for i in (0, 1) for j in range(2, 7))
    # x, y and one of the heavy ones meet in one bucket; the heavy ones meet in another
    meet = {0: [1], 1: [1], 2: [1, 2], 3: [2], 4: [2], 5: [2], 6: [1]}
    known = neardup.sketches(docs(spark, texts)).collect()
    rows = [(r.doc_id, r.text_key, r.n_shingles, r.set_key, r.sketch, meet[r.doc_id]) for r in known]
    held = spark.createDataFrame(rows, "doc_id long, text_key long, n_shingles long, set_key binary, sketch binary, bands array<long>")
    monkeypatch.setattr(neardup, "sketches", lambda _: held)
    for size in (neardup.BLOCK_ROWS, 1):
        monkeypatch.setattr(neardup, "BLOCK_ROWS", size)
        got = sorted(neardup.near_duplicates(docs(spark, texts)).collect())
        assert [(r.n_shingles, r.component_id) for r in got] == _components(texts)
        assert [r.component_id for r in got][:2] == [0, 0]


def test_near_duplicates_of_odd_rows(spark):
    got = neardup.near_duplicates(odd(spark)).collect()
    assert len(got) == 7 and sum(r.doc_id == 4 and r.component_id == 4 for r in got) == 2
    assert neardup.near_duplicates(docs(spark, [])).count() == 0 and neardup.drop_copies(docs(spark, [])).count() == 0
    clash = odd(spark).withColumns({k: F.lit("mine") for k in ("row", "text_key", "group", "kept", "rep")})
    kept = neardup.drop_copies(clash)
    assert kept.columns == clash.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5]


def test_near_duplicates_of_repeated_ids(spark):
    rng = random.Random(15)
    a, b, c = ([f"w{rng.random()}" for _ in range(60)] for _ in range(3))
    near = lambda t: " ".join([*t[:59], "x"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(b)), (3, near(a)), (4, " ".join(c)), (4, near(c)), (4, " ".join(c)), (0, near(near(a).split())), (5, None), (5, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in neardup.near_duplicates(frame).collect())
    assert got == [(0, 0), (1, 0), (1, 1), (2, 1), (3, 0), (4, 4), (4, 4), (4, 4), (5, 5), (5, 5)]
    kept = [(r.doc_id, (r.text or "")[:6]) for r in neardup.drop_copies(frame).collect()]
    assert sorted(kept) == sorted([(0, a[0][:6]), (1, b[0][:6]), (4, c[0][:6]), (5, "")])


def test_hubs_of_many_pairs(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PAIRS_TOGETHER", 3)
    rng = random.Random(16)
    base = [f"b{i}" for i in range(100)]
    texts = [" ".join(base)]
    for k in range(30):
        one = list(base)
        one[rng.randrange(100)] = f"x{k}"
        texts.append(" ".join(one))
    got = sorted(neardup.near_duplicates(docs(spark, texts)).collect())
    assert [(r.n_shingles, r.component_id) for r in got] == _components(texts)


def test_recall_at_the_limit(spark):
    """Pairs with a similarity of 0.75 or just above, of sets of 11 to 300 shingles: all are found."""
    rng = random.Random(17)
    texts = []
    for k in range(600):
        n = (11, 20, 40, 80, 150, 300)[k % 6]
        base = [f"w{rng.random()}" for _ in range(n + 4)]
        same = next(m for m in range(n) if 100 * m >= 75 * (2 * n - m))
        texts += [" ".join(base), " ".join([*base[: same + 4], *(f"x{rng.random()}" for _ in range(n - same))])]
    for i in range(0, len(texts), 2):
        a, b = _shingles(texts[i]), _shingles(texts[i + 1])
        assert 0.75 <= len(a & b) / len(a | b) < 0.84
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(spark, texts)).collect()}
    assert all(got[i + 1] == i for i in range(0, len(texts), 2))


def test_sketch_estimates():
    rng = np.random.default_rng(1)
    for share in (0.0, 0.3, 0.8, 1.0):
        off = []
        for _ in range(40):
            x = np.unique(rng.integers(0, 2**63, 300, dtype=np.int64).astype(np.uint64) * np.uint64(2))
            k = int(len(x) * share)
            y = np.unique(np.concatenate([x[:k], rng.integers(0, 2**63, len(x) - k, dtype=np.int64).astype(np.uint64) * np.uint64(2)]))
            true = k / (2 * len(x) - k)
            off.append((neardup.sketch(x, 256) == neardup.sketch(y, 256)).mean() - true)
        assert abs(np.mean(off)) < 0.02
    assert not neardup.sketch(np.zeros(0, np.uint64)).any() and not neardup.fine_sketch(np.zeros(0, np.uint64)).any()


# ---------------------------------------------------------------- 5, 9, 10


def _tables(spark, sf="sf0.01"):
    return spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"), spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")


def _crc(i, m):
    return zlib.crc32(str(i).encode()) % m


def test_toxicity_on_held_out_rows(spark):
    d, labels = _tables(spark)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = toxicity.toxicity_of(d, labels).collect()
    assert all(r.held_out == (_crc(r.doc_id, 5) == 0) and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    pos, neg = ([r.score for r in held if truth[r.doc_id] == v] for v in (1, 0))
    assert np.mean([p > n for p in pos for n in neg]) > 0.85
    assert np.mean([n < 0.5 for n in neg]) > 0.9


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1, 1), (3, 1, 0), (9, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for found in (labels, labels.limit(0)):
        got = toxicity.toxicity_of(odd(spark), found).collect()
        assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
        got = quality.quality_of(odd(spark), found).collect()
        assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    clash = odd(spark).withColumns({k: F.lit("mine") for k in ("score", "label", "h", "predicted")})
    for of in (toxicity.toxicity_of, quality.quality_of):
        assert of(clash, labels).count() == 7 and of(docs(spark, []), labels).count() == 0
        assert of(odd(spark), labels).columns == ["doc_id", "held_out", "score", "predicted"]


def test_samples_are_bounded(spark):
    rows = docs(spark, ["x" * 1000] * 300).select("doc_id", "text")
    assert common.bounded_rows(rows, "doc_id", 10**6).count() == 300
    assert 20 < common.bounded_rows(rows, "doc_id", 10**5).count() < 180


def test_quality_on_held_out_rows(spark):
    d, labels = _tables(spark)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = quality.quality_of(d, labels).collect()
    assert all(r.held_out == (_crc(r.doc_id, 4) == 2) and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95


def test_dual_descent_separates():
    rows = [np.array([0, 2]), np.array([0, 3]), np.array([1, 2]), np.array([1, 3])]
    w, b = quality.dual_descent(rows, np.ones(4), np.array([1, 1, -1, -1]), np.full(4, 10.0), epochs=100)
    assert (np.sign(quality.margins(w, b, rows)) == [1, 1, -1, -1]).all()


def test_language_on_held_out_rows(spark):
    d, _ = _tables(spark)
    truth = {r.doc_id: r.lang for r in d.select("doc_id", "lang").collect()}
    got = langid.language_of(d).collect()
    assert all(r.held_out == (_crc(r.doc_id, 3) == 1) for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got if r.held_out]) > 0.95
    assert np.mean([r.rejected for r in got]) < 0.01


UNLEARNED = """
これは日本語のテキストです。かなり長い文章ではありませんが、言語識別のためには十分な長さがあると思います。
هذا نص مكتوب باللغة العربية وهو ليس طويلا جدا ولكنه يكفي لاختبار التعرف على اللغة في هذا البرنامج الجديد
Это текст на русском языке, который не очень длинный, но достаточный для проверки определения языка
Questo testo è scritto in lingua italiana e non è molto lungo ma basta per provare il riconoscimento
Deze tekst is in het Nederlands geschreven en is niet erg lang maar voldoende om de herkenning te testen
Ten tekst jest napisany po polsku i nie jest bardzo długi, ale wystarczy do sprawdzenia rozpoznawania
Bu metin Türkçe yazılmıştır ve çok uzun değildir ama bu yeni programda dil tanımayı denemek için yeterlidir
Tämä teksti on kirjoitettu suomeksi eikä se ole kovin pitkä mutta se riittää kielen tunnistamisen kokeiluun
Mae'r testun hwn wedi ei ysgrifennu yn Gymraeg ac nid yw'n hir iawn ond mae'n ddigon i brofi adnabod iaith
이 글은 한국어로 쓰여 있으며 그리 길지 않지만 언어 식별을 시험하기에는 충분하다고 생각합니다
""".strip().splitlines()


def test_languages_not_learned_are_rejected(spark):
    d, _ = _tables(spark)
    model = langid.fit(d)
    rng = random.Random(4)
    noise = ["".join(rng.choice("bcdfghjklmnpqrstvwxz   ") for _ in range(100)) for _ in range(5)]
    texts = [(x * 6)[:n] for x in [*UNLEARNED, *noise] for n in (20, 40, 80, 160, 500)]
    assert np.mean([r.rejected for r in langid.identify(docs(spark, texts), model).collect()]) >= 0.9
    held = langid.identify(d, model).filter(common.held_out(3, 1)).collect()
    assert np.mean([r.rejected for r in held]) < 0.01


def test_language_of_odd_rows(spark):
    d, _ = _tables(spark)
    model = langid.fit(d)
    more = docs(spark, [None, "", "123 ???", UNLEARNED[0], "the of and"])
    got = {r.doc_id: r for r in langid.identify(more, model).collect()}
    assert [got[i].lang_pred for i in range(3)] == ["und"] * 3 and all(got[i].rejected and got[i].score == 0 for i in range(3))
    assert got[3].rejected and got[3].lang_pred in model.languages and got[4].lang_pred == "en"
    assert langid.fit(docs(spark, [])) is None
    assert {r.lang_pred for r in langid.identify(more, None).collect()} == {"und"}
    clash = more.withColumn("rejected", F.lit("mine")).withColumn("_text", F.lit(1))
    assert langid.identify(clash, model, keep=("doc_id", "rejected", "_text")).columns == ["doc_id", "_text", "lang_pred", "score", "rejected"]
    packed = langid.identify(clash.select(common.as_row(clash), "text"), model, keep=("row",)).filter("NOT rejected").select("row.*").collect()
    assert all(r.rejected == "mine" and r._text == 1 for r in packed)
    assert langid.language_of(odd(spark)).count() == 7 and langid.language_of(docs(spark, [])).count() == 0


# ---------------------------------------------------------------- 6


def test_leaks_are_found(spark):
    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijkl") for _ in range(5)) for _ in range(n))
    items = [words(30) for _ in range(5)] + ["Alice has 12 apples and buys 7 more from Bob every day until she owns 40 fruits in total", "too short", None, "five words only in this"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [f"{words(40)} {items[0]} {words(40)}", words(200), "Then Maria has 15 apples and buys 3 more from Tom every day until she owns 90 fruits in total.", f"{words(20)} {items[1].upper()}", None, "", f"{words(5)} five words only in this {words(5)}", " ".join(items[2].split()[:8]) + words(60)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark, texts), bench).collect()}
    assert got == {(0, 0), (2, 5), (3, 1), (6, 8)}
    kept = decontaminate.drop_contaminated(docs(spark, texts), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 7] and kept.columns == docs(spark, texts).columns


def test_slots_must_correspond(spark):
    item = "Take 3 red balls then add 5 blue balls and give 3 to the boy so 5 stay in the box and 3 go out"
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    same = item.replace("3", "8").replace("5", "9")
    jumbled = "Take 1 red balls then add 2 blue balls and give 4 to the boy so 6 stay in the box and 7 go out"
    got = [r.doc_id for r in decontaminate.contaminated(docs(spark, [same, jumbled]), bench).collect()]
    assert got == [0]


def test_names_that_begin_sentences(spark):
    item = "Tom has 5 apples. Ann has 7 pears. Tom gives 2 apples to Ann. How many apples does Tom have?"
    other = item.replace("Tom", "Maria").replace("Ann", "Piet").replace("5", "15").replace("7", "30").replace("2", "12")
    bench = spark.createDataFrame([(0, item), (1, "What is the highest mountain in Spain?")], "item_id long, text string")
    texts = [other, item.upper(), f"question {item.lower()}", "Q What is the highest mountain in Spain? A", "so: what is the highest MOUNTAIN in spain", other.replace("Maria gives", "Oscar gives").replace("to Piet", "to Quinn").replace("does Maria", "does Zoe"), "What is the lowest valley in Spain?"]
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark, texts), bench).collect())
    assert got == [(0, 0), (1, 0), (2, 0), (3, 1), (4, 1)]


def test_short_items(spark):
    bench = spark.createDataFrame([(0, "Who wrote Hamlet?"), (1, "12 + 7 - 3 = 16 apples"), (2, "word"), (3, "1 2 3 4 5 6 7 8 9 10 11 12"), (4, "5 km")], "item_id long, text string")
    texts = ["Tell me: who wrote Hamlet? Nobody.", "so 12 + 7 - 3 = 16 Apples.", "12 + 8 - 3 = 17 apples", "a word", "0 1 2 3 4 5 6 7 8 9 10 11 12 13", "1 2 3 4 5 6 7 8 9", "who wrote Macbeth", "6 km"]
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark, texts), bench).collect())
    assert got == [(0, 0), (1, 1), (4, 3)]


def _plain(text):
    return [w.lower() for w in regex.findall(r"\p{L}[\p{L}\p{M}]*|\p{N}+(?:[.,]\p{N}+)*|[%$€£]", text or "")]


def _template(text):
    out = []
    for w in regex.findall(r"\p{L}[\p{L}\p{M}]*|\p{N}+(?:[.,]\p{N}+)*|[%$€£]", text or ""):
        kind = "<unit>" if w.lower() in [*decontaminate.UNITS, "%", "$", "€", "£"] else "<num>" if regex.match(r"\p{N}", w) else "<name>" if len(w) > 1 and regex.fullmatch(r"\p{Lu}[^\p{Lu}]+", w) else w.lower()
        out.append((kind, w.lower()))
    return out


def _holds(text, item):
    """Brute force: whether a text holds an item by its template or by its words."""
    d, b = _template(text), _template(item)
    if len(b) < 2:
        return False
    n = min(8, len(b))
    runs = lambda t, k: [tuple(x[k] for x in t[i : i + n]) for i in range(len(t) - n + 1)]
    usable = {w: i for i, w in reversed(list(enumerate(runs(b, 0)))) if sum(not x.startswith("<") for x in w) >= 4}
    plain = set(runs(b, 1))
    found = plain & set(runs(d, 1))
    if len(found) >= (len(plain) if len(usable) < 2 else len(plain) / 2):
        return True
    at = [(usable[w], j) for j, w in enumerate(runs(d, 0)) if w in usable]
    if not at or len({i for i, _ in at}) < len(usable) / 2:
        return False
    copies, last = [at, []], None
    for i, j in sorted(at, key=lambda m: m[1] - m[0]):
        if last is not None and j - i - last > 4:
            copies.append([])
        copies[-1].append((i, j))
        last = j - i
    for copy in copies:
        pairs = {(b[i + k][1], d[j + k][1]) for i, j in copy for k in range(n) if b[i + k][0].startswith("<")}
        if len({i for i, _ in copy}) >= len(usable) / 2 and (not pairs or (len({x for x, _ in pairs}) >= 0.75 * len(pairs) and len({y for _, y in pairs}) >= 0.6 * len(pairs))):
            return True
    return False


def test_variants_of_one_question_in_a_text(spark):
    item = "Alice has 12 apples and buys 7 more from Bob every day until she owns 30 fruits in total at the market"
    variant = lambda *v: item.replace("Alice", v[0]).replace("12", v[1]).replace("7", v[2]).replace("Bob", v[3]).replace("30", v[4])
    many = [variant("Maria", "15", "3", "Tom", "90"), variant("Oscar", "21", "4", "Piet", "50"), variant("Zoe", "8", "6", "Max", "77"), item]
    flat = "Take 12 red balls then add 7 blue balls and give 30 to the boy at once in the park"
    bench = spark.createDataFrame([(0, item), (1, flat), (2, "word"), (3, None)], "item_id long, text string")
    texts = [many[0], " ".join(many[:2]), "\n".join(many[:3]), f"{many[0]} and {many[3]}", f"{many[3]} {many[1]} {many[2]} some words {many[0]}", flat.replace("12", "1").replace("7", "1").replace("30", "1"), flat.replace("12", "4").replace("7", "4").replace("30", "9"), "and buys 3 more from Tom every day until Alice has 12 apples"]
    got = sorted((r.doc_id, r.item_id, r.n_matched) for r in decontaminate.contaminated(docs(spark, texts), bench).collect())
    assert [g[:2] for g in got] == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (6, 1)]
    assert sorted((r.item_id, r.n_words) for r in decontaminate.not_looked_for(bench).collect()) == [(2, 1), (3, 0)]
    assert decontaminate.contaminated(docs(spark, texts), bench, least_words=30).count() == 0


def test_leaks_against_brute_force(spark):
    rng = random.Random(18)
    pool = ["the", "a", "in", "box", "red", "blue", "takes", "Tom", "Ann", "Émile", "NASA", "12", "3.5", "7", "km", "kg", "%", "über", "und", "x", "Of", "٣"]
    say = lambda n: " ".join(rng.choice(pool) + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))
    items = [say(rng.randint(0, 25)) for _ in range(25)] + ["", None, "Tom"]
    texts = []
    for _ in range(120):
        item = rng.choice(items) or ""
        words = item.split(" ")
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(pool)
        inner = " ".join(words)
        if rng.random() < 0.3:  # a second copy with other values
            inner += f" {say(rng.randint(0, 6))} " + " ".join(rng.choice(["Max", "Zoe", "5", "9", "g"]) if w in ("Tom", "Ann", "12", "7", "km", "kg") else w for w in item.split(" "))
        texts.append(f"{say(rng.randint(0, 9))} {rng.choice([inner, inner.upper(), inner.lower()])} {say(rng.randint(0, 9))}")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark, texts), bench).collect()}
    assert got == {(i, k) for i, t in enumerate(texts) for k, item in enumerate(items) if _holds(t, item)}


def test_leaks_of_odd_rows(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(odd(spark), empty).count() == 0
    assert decontaminate.drop_contaminated(odd(spark), empty).count() == 7
    bench = spark.createDataFrame([(0, "same same"), (0, "some text of no id"), (None, "word word word"), (1, None)], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id) for r in decontaminate.contaminated(odd(spark), bench).collect())
    assert got == [(0, 0), (3, None), (4, 0)]
    assert decontaminate.contaminated(docs(spark, []), bench).count() == 0
    clash = odd(spark).withColumns({k: F.lit("mine") for k in ("row_id", "_row_id", "row", "words", "item")})
    kept = decontaminate.drop_contaminated(clash, bench)
    assert kept.columns == clash.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 5]


# ---------------------------------------------------------------- 7


def test_fingerprints(spark):
    texts = ["Éa ß x 🎉🎉 ab c d e f g h", None, "", "a b", "a b"] + [" ".join(f"w{(i * 7 + k) % 90}" for k in range(60)) for i in range(6)]
    got = sorted(fingerprints.likeness_of_edits(docs(spark, texts)).collect())
    full = [t or "" for t in texts]
    for i, r in enumerate(got):
        t, after = full[i], full[(i + 1) % len(full)]
        h = len(t) // 2
        edited = t[: len(t) - h] + after[:h]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for other, near in ((edited, r.near_edited), (after, r.near_next)):
            a, b = _shingles(t.lower()), _shingles(other.lower())
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(near - true) < 0.25
    assert got[3].fingerprint == got[4].fingerprint != "" and got[1].fingerprint == "" and got[3].near_next == 1.0


def test_fingerprints_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 2)
    monkeypatch.setattr(fingerprints.math, "isqrt", lambda n: 2)
    texts = [f"text number {i} of many" for i in range(50)]
    got = sorted(fingerprints.likeness_of_edits(docs(spark, texts)).collect())
    for i, r in enumerate(got):
        t, after = texts[i], texts[(i + 1) % 50]
        h = len(t) // 2
        assert r.edited_sha256 == hashlib.sha256((t[: len(t) - h] + after[:h]).encode()).hexdigest()


def test_fingerprints_of_odd_rows(spark):
    assert fingerprints.likeness_of_edits(odd(spark)).count() == 7
    assert fingerprints.likeness_of_edits(docs(spark, [])).count() == 0


# ---------------------------------------------------------------- 8


def test_licenses_against_brute_force(spark):
    rng = random.Random(9)
    parts = ["under the MIT license", "Apache License, Version 2", "CC-BY-NC", "cc by nc", "mit", "license", "é", "under the", "2.0", "x", "cc", "by"]
    texts = [None, "", "Licensed under the Apache License, Version 2.0."] + [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 20))) for _ in range(60)]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for r in licenses.scan(docs(spark, texts)).collect():
        w = word.findall((texts[r.doc_id] or "").translate(FOLD))
        at = [(i, label) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        base = sorted({label for _, label in at})
        assert r.base_labels == ",".join(base) and set(base) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_suppression(spark):
    got = licenses.scan(docs(spark, ["Released under the terms of the GNU Lesser General Public License, version 2.1 only.", "CC BY-NC-SA 4.0", "All rights reserved.", "no such thing"])).collect()
    assert [r.labels for r in sorted(got)] == ["lgpl-2.1", "cc-by-nc,cc-by-nc-sa", "proprietary", ""]
    assert licenses.scan(odd(spark)).count() == 7 and licenses.scan(docs(spark, [])).count() == 0
    assert len(licenses.rules()) > 300


def test_clauses_and_short_names(spark):
    texts = {
        "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")", "Released under MIT.", "Licensed under the MIT/X11 terms"],
        "apache-2": ["you may not use this file except in compliance with the License.", "Licensed under Apache 2.0"],
        "bsd-4": ["All advertising materials mentioning features or use of this software must display the following acknowledgement:"],
        "gpl-2": ["as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. gnu"],
        "mpl-2": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
        "unlicense": ["This is free and unencumbered software released into the public domain."],
        "cc-by-sa": ["see https://creativecommons.org/licenses/by-sa/4.0/"],
        "zlib": ["Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."],
        "": ["They permit it under mitigating circumstances", "the bsd of it", "apache helicopters under way"],
    }
    flat = [(k, t) for k, some in texts.items() for t in some]
    got = sorted(licenses.scan(docs(spark, [t for _, t in flat])).collect())
    assert [r.labels for r in got] == [k for k, _ in flat]


def _labels(text):
    """Brute force: every rule over the word line, and what no other detection covers."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    line = f" {' '.join(words)} "
    found = [(m.start(), m.end(), p, i, label, c) for i, label, p, c, keyword, _, pattern in licenses.rules() if keyword in line for m in re.finditer(pattern, line)]
    over = lambda e, d: e[0] <= d[0] and e[1] >= d[1] and (e[2] > d[2] or (e[2] == d[2] and (e[1] - e[0] > d[1] - d[0] or (e[1] - e[0] == d[1] - d[0] and e[3] < d[3]))))
    kept = [d for d in found if not any(over(e, d) for e in found)]
    base = {label for phrase, label in licenses.BASE.items() if f" {phrase} " in line}
    return ",".join(sorted({d[4] for d in kept} | base)), max([d[5] for d in kept] + [0.95] * bool(base) + [0.0])


def test_labels_and_scores_against_brute_force(spark):
    rng = random.Random(19)
    parts = ["licensed under the", "MIT license", "under the MIT license", "GNU General Public License version 3", "GPL v2", "or later", "cc-by-nc-sa 4.0", "Creative Commons Attribution", "SPDX-License-Identifier: MIT", "SPDX-License-Identifier: LGPL-2.1-only", "you may not use this file except in compliance with the License", "apache", "2.0", "BSD 3-Clause license", "all rights reserved", "released under mit", "free text", "and", "the x", "Mozilla Public License 2.0", "under the terms of the"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(80)]
    for r in licenses.scan(docs(spark, texts)).collect():
        assert (r.labels, r.score) == _labels(texts[r.doc_id])


def test_long_text_of_licenses(spark):
    text = "Licensed under the MIT license or the GNU General Public License version 3, all rights reserved. " * 1900
    frame = docs(spark, [text])
    licenses.scan(docs(spark, ["mit license"])).collect()
    began = time.time()
    assert licenses.scan(frame).first().labels == "gpl-3,mit,proprietary"
    assert time.time() - began < 20  # 5 on a machine of its own


def test_licenses_with_clashing_names(spark):
    clash = odd(spark).withColumns({k: F.lit("mine") for k in ("labels", "_text", "_row", "_line")})
    got = licenses.scan(clash, keep=("doc_id", "labels", "_text", "_row", "_line"))
    assert got.columns[:4] == ["doc_id", "_text", "_row", "_line"] and got.count() == 7 and {r._line for r in got.collect()} == {"mine"}


def test_spdx_identifiers_and_expat(spark):
    named = {"MIT": "mit", "ISC": "isc", "MPL-2.0": "mpl-2", "EPL-2.0": "epl-2", "Zlib": "zlib", "BSL-1.0": "bsl-1", "Artistic-2.0": "artistic-2", "MIT-0": "mit-0", "LGPL-2.1": "lgpl-2.1", "LGPL-2.1-or-later": "lgpl-2.1", "GPL-3.0-only": "gpl-3", "BSD-3-Clause": "bsd-3", "MIT-CMU": ""}
    texts = [f"// SPDX-License-Identifier: {k}\nint main" for k in named]
    got = sorted(licenses.scan(docs(spark, [*texts, "Released under the Expat License."])).collect())
    assert [r.labels for r in got] == [*named.values(), "mit"]
    assert [r.score for r in got] == [1.0 if v else 0.0 for v in named.values()] + [0.95]


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs_ = spark.read.parquet(f"{sf}/documents.parquet")
    frame = docs_
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = frame
        frame = stage(spark, frame, sf)
        if k < len(pipeline.STAGES) - 1:
            path = common.shared_path(spark, name)
            frame.write.parquet(path)
            frame = spark.read.parquet(path)
            assert frame.columns == docs_.columns
        if name == "minhash_near_dedup":
            rows = sorted((r.doc_id, r.text) for r in before.collect())
            keep = {rows[c][0] for _, c in _components([t for _, t in rows])}
            assert {r.doc_id for r in frame.select("doc_id").collect()} == keep
    direct = pipeline.run(spark, sf).select("doc_id", "ids_sha256").collect()
    assert sorted(direct) == sorted(frame.select("doc_id", "ids_sha256").collect())


def test_stages_of_odd_rows(spark):
    """Nulls, repeated rows, very long texts, clashing names and empty tables go through every stage; columns stay as they are."""
    pipeline = pytest.importorskip("corpus_pipeline")
    clash = odd(spark).withColumns({k: F.lit("mine") for k in ("row", "row_id", "rejected", "n_lines", "kept", "text_key", "n_tokens", "_text")})
    for frame, ids in ((clash, [1, 3, 4, 4, None]), (clash.limit(0), [])):
        for name, stage in pipeline.STAGES:
            out = stage(spark, frame, "/root/testdata/sf0.001")
            rows = out.collect()
            if name != "byte_bpe":
                assert out.columns == clash.columns and all(r.row == r.kept == "mine" for r in rows)
            if name == "byte_bpe":
                assert len(rows) == (7 if ids else 0)
            elif name == "language_id":
                assert {r.doc_id for r in rows} <= {None, 3, 4} and all(r.text for r in rows)
            elif name == "minhash_near_dedup":
                assert sorted(r.doc_id or 0 for r in rows) == ([0, 1, 2, 3, 4, 5] if ids else [])
            else:
                assert len(rows) == (7 if ids else 0)


def test_chunks_of_arrow_text():
    texts = pa.array(["A b c d e f", None, "", "x y"]).slice(1)
    runs = list(common.text_chunks(texts, 2))
    assert runs[0][0] == 0 and runs[-1][1] == 3
    sets = [s for _, _, d, o in runs for s in common.shingle_sets(d, o)]
    assert [len(s) for s in sets] == [0, 0, 1]
