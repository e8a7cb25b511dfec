"""Source divergence, token alignment and personal data against brute force."""

import hashlib
import random
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from stemma.llm import bpe, divergence, langid, licenses, pii, tokenalign, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, (t, lang, source) in enumerate(rows)], DOCS)


def odd(spark):
    rows = [(1, None, None, None, None, "a"), (None, "some text of no id", "en", "s", 18, "b"), (2, "", "en", "t", 0, None), (3, "word " * 30000, "en", "s", 150000, "c"), (4, "same same", "en", "s", 9, "d"), (4, "same same", "en", "u", 9, "d"), (5, " \n\t ", "de", "s", 4, "e")]
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOCS + ", n_a string, value string, links string, spans string")


# ---------------------------------------------------------------- 11


def brute_divergence(rows, least=3, top=200):
    import re

    tokens = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))) for t, lang, source in rows]
    out = []
    for lang in {x[0] for x in tokens}:
        mine = [x for x in tokens if x[0] == lang]
        spread = Counter(w for x in mine for w in set(x[2]))
        kept = {w for w, n in spread.items() if n >= least}
        count = defaultdict(Counter)
        for _, source, words in mine:
            count[source].update(w for w in words if w in kept)
            count[None].update(w for w in words if w in kept)
        p = {s: {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept} for s, c in count.items()}
        f = lambda a, b: int(Fraction((a - b) ** 2, b).__floor__())
        for s in count.keys() - {None}:
            pairs = sorted((-sum(f(p[s][w], p[o][w]) for w in kept), o.encode()) for o in count.keys() - {None, s})
            out += [(lang, s, "pair", o.decode(), -v, k + 1) for k, (v, o) in enumerate(pairs)]
            terms = sorted((-f(p[s][w], p[None][w]), w.encode()) for w in kept if count[s][w] and p[s][w] > p[None][w])[:top]
            out += [(lang, s, "term", w.decode(), -v, k + 1) for k, (v, w) in enumerate(terms)]
    return sorted(out)


def test_divergence_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 7)
    monkeypatch.setattr(divergence, "PACK_ROWS", 40)
    monkeypatch.setattr(divergence, "HEAP_ROWS", 30)
    rng = random.Random(5)
    words = ["Été", "zoo", "A", "b", "Ωmega", "it's", "x1y", "日本"] + [rng.choice("abcd") * rng.randint(1, 6) for _ in range(40)]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 60))), rng.choice(["en", "de", None]), rng.choice(["s0"] * 4 + ["s1", "s2", "s3", "ü", None])) for _ in range(150)]
    rows += [("once", "fr", "s0"), (None, "fr", "s1"), ("", "fr", "s2"), ("alone", "it", "s0")]
    got = sorted(tuple(r) for r in divergence.audit(docs(spark, rows), top=12).collect())
    assert got == brute_divergence(rows, top=12)
    assert {r[:5] for r in got if r[0] == "fr"} == {("fr", a, "pair", b, 0) for a in ("s0", "s1", "s2") for b in ("s0", "s1", "s2") if a != b}


def test_divergence_of_odd_rows(spark):
    got = divergence.audit(odd(spark)).collect()
    assert all(r.part == "pair" or r.value >= 0 for r in got)
    assert {(r.lang, r.source) for r in got if r.part == "pair"} == {("en", "s"), ("en", "t"), ("en", "u")}
    assert divergence.audit(docs(spark, [])).count() == 0


def test_shares_are_exact():
    rng = random.Random(1)
    for _ in range(2000):
        of = rng.randint(1, 10 ** rng.randint(1, 15))
        n = rng.randint(0, of - 1)
        assert divergence.share(np.array([n]), np.array([of]))[0] == 1 + 10**9 * (n + 1) // of


def test_every_pair_meets_once_in_rounds(spark):
    from pyspark.sql import functions as F

    for seats in (1, 2, 3, 6, 7):
        pairs = [(i, j, seats) for i, j in combinations(range(seats), 2)]
        frame = spark.createDataFrame(pairs, "i int, j int, seats int") if pairs else spark.createDataFrame([], "i int, j int, seats int")
        got = frame.select("i", "j", divergence.round_of(F.col("i"), F.col("j"), F.col("seats")).alias("r")).collect()
        at = defaultdict(list)
        for r in got:
            at[r.r] += [r.i, r.j]
        assert all(len(set(x)) == len(x) for x in at.values())
        assert len(at) <= seats - 1 + seats % 2


# ---------------------------------------------------------------- 12


def paths():
    import public_tokenizers as p

    return p.path("byte_bpe_50k.json"), p.path("piece_bpe_32k.model")


def brute_alignment(texts):
    a, b = tokenalign.ByteLevel(paths()[0]), tokenalign.Pieces(paths()[1])
    found, docs_of = [], Counter()
    for t in texts:
        if not t:
            found.append(None)
            continue
        x, y = a.of.encode(" " + t, add_special_tokens=False).ids, b.of.encode(t)
        bx, by = [a.tokens[i] for i in x], [b.tokens[i] for i in y]
        if not b"".join(bx) == b"".join(by) == (" " + t).encode():
            found.append(None)
            continue
        spans = [list(zip(np.cumsum([0, *map(len, s[:-1])]).tolist(), np.cumsum([len(k) for k in s]).tolist())) for s in (bx, by)]
        links = [(x[i], y[j]) for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if max(s, u) < min(e, v)]
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, at = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(k) for k, (s, e) in zip(ids, sp) if at <= s < end) for ids, sp in ((x, spans[0]), (y, spans[1]))))
            at = end
        found.append((x, y, links, ";".join(groups)))
        docs_of.update(set(links))
    most = defaultdict(int)
    for (i, _), n in docs_of.items():
        most[i] = max(most[i], n)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else (len(f[0]), len(f[1]), f[3].count(";") + 1, len(f[2]), sum(docs_of[k] == most[k[0]] for k in f[2]), sum(docs_of[k] for k in f[2]), hashlib.sha256(f[3].encode()).hexdigest()) for f in found]


def odd_texts():
    rng = random.Random(3)
    texts = [None, "", " ", "  ", "a", " a", "a ", "a  b", "\n a", "a\n  b", "a\t b\r\n", "a\x00b", "<s> </s>x", "<|endoftext|> a", "a▁b", "x\xa0 y", "x\x85 y", "x  y", "x᠎ y z​ ", "it's we'll 's 're", "日本 語", "🎉🎉 x 🎉", "ﬁn", "é é", "same same", "same same", "naïve café", "a" * 300, " " * 50 + "x"]
    texts += ["".join(rng.choice("abcé日 \n'sT1!r  e\x85▁"[: rng.choice([12, 17, 18])]) for _ in range(rng.randint(0, 120))) for _ in range(150)]
    texts += [" ".join(rng.choice(["the", "table", "unbelievable", "tokens,", "don't", "1234567", "(x)"]) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    return texts


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("sent", [10_000_000, 0])
def test_alignment_equals_brute_force(spark, sent):
    texts = odd_texts()
    want = brute_alignment(texts)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = tokenalign.align_documents(rows, *paths(), sent_pairs=sent).orderBy("doc_id").collect()
    for t, w, r in zip(texts, want, got):
        assert tuple(r[c] for c in COLUMNS) == w, t


def test_alignment_forgets(spark, monkeypatch):
    monkeypatch.setattr(tokenalign, "MEMO", 5)
    monkeypatch.setattr(tokenalign, "RUN_CHARS", 50)
    aligner = tokenalign.Aligner(*paths())
    for texts in (["one two three one", "four five one six"], ["one seven"], ["two two eight"], ["one nine " * 9]):
        numbers, has = aligner.read(texts)
        fresh = tokenalign.Aligner(*paths())
        other, _ = fresh.read(texts)
        assert [aligner.counts[:, k].tolist() for k in numbers] == [fresh.counts[:, k].tolist() for k in other] and has.all()
        assert all((x == y).all() for x, y in zip(tokenalign._links(aligner, numbers, has), tokenalign._links(fresh, other, has)))
        assert [[aligner.groups[i] for i in k] for k in numbers] == [[fresh.groups[i] for i in k] for k in other]
    assert len(aligner.memo) <= 7


def test_words_of_a_text_are_cut_where_neither_tokenizer_joins():
    a, b = tokenalign.ByteLevel(paths()[0]), tokenalign.Pieces(paths()[1])
    for c in range(0x110000):  # every character before and after a space
        if 0xD800 <= c < 0xE000 or (c > 0x3100 and c % 97):
            continue
        text = f"x{chr(c)} y {chr(c)} z"
        words = tokenalign.Aligner.words(text)
        assert "".join(f" {w}" for w in words) == " " + text
        assert a.of.encode(" " + text, add_special_tokens=False).ids == [i for x in a.encode(words) for i in x], hex(c)
        assert b.of.encode(text) == [i for x in b.encode(words) for i in x], hex(c)


def test_alignment_of_odd_rows(spark):
    for sent in (10, 0):
        got = tokenalign.align_documents(odd(spark), *paths(), keep=("doc_id", "n_a", "links"), sent_pairs=sent).collect()
        assert len(got) == 7 and {r.n_links for r in got if r.doc_id in (1, 2)} == {0}
        assert got[0].asDict().keys() == {"doc_id", "links", *COLUMNS}
    assert tokenalign.align_documents(docs(spark, []), *paths()).count() == 0


def test_group_products(spark):
    groups = tokenalign.aligned_groups(docs(spark, [("unbelievable tokens", "en", "s"), (None, "en", "s")]), *paths())
    rows = groups.orderBy("group_no").collect()
    assert tokenalign.group_products(groups).count() == sum(len(r.a) * len(r.b) for r in rows) and len(rows) > 1


# ---------------------------------------------------------------- 13


def brute_base(text):
    import re

    out = [("email", m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        doubled = [x * 2 - 9 * (x > 4) if k % 2 else x for k, x in enumerate(reversed(d))]
        out += [("card", m.span())] * (13 <= len(d) <= 19 and sum(doubled) % 10 == 0)
    out += [("phone", m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return [(pii.KINDS.index(k), *s) for k, s in out]


def test_patterns_equal_brute_force():
    rng = random.Random(7)
    pieces = ["a", "Z9", "@", "@@", ".", "..", "-", "+", "+1", " ", "(", ")", "255", "256", "0", "1.2.3.4", "10.0.0.1.5", "4713332104704538", "4713 3321-0470 4538", "x.y@z.com", "@b.co", "%_", "é", "\n", "+49 (30) 90", "1820", "٣"]
    for _ in range(6000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == brute_base(text), text
    long = "1" * 200_000 + " " + "a@" * 50_000 + "+1(" * 50_000
    assert pii.base_spans(long) == brute_base("") + [s for s in pii.base_spans(long)]  # ends in time
    assert pii.base_spans("1." * 100_000 + "x@" + "b-" * 100_000) is not None


@pytest.fixture(scope="module")
def field(spark):
    return pii.fit(pii.labelled_table(spark))


def test_viterbi_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    field = pii.Field({}, np.zeros((0, len(pii.LABELS))), rng.normal(size=(len(pii.LABELS),) * 2))
    runs = [rng.normal(size=(n, len(pii.LABELS))) for n in (3, 1, 2, 3, 1)]

    def value(scores, path):
        if not pii.ALLOWED[0, path[0]]:
            return -np.inf
        return sum(scores[t, k] for t, k in enumerate(path)) + sum(field.moves[a, b] for a, b in zip(path, path[1:]))

    for scores, got in zip(runs, field.decode(runs)):
        best = max(product(range(len(pii.LABELS)), repeat=len(scores)), key=lambda p: value(scores, p))
        assert tuple(got.tolist()) == best
    assert field.decode([]) == []


def test_gradients_equal_differences():
    rng = np.random.default_rng(2)
    scores, labels = rng.normal(size=(4, len(pii.LABELS))), np.array([0, 1, 2, 0])
    moves = np.where(pii.ALLOWED, rng.normal(size=(len(pii.LABELS),) * 2), -np.inf)
    value, by_word, by_move = pii.likelihood(scores, moves, labels)
    for t, k in ((0, 0), (1, 3), (2, 2), (3, 5)):
        more = scores.copy()
        more[t, k] += 1e-6
        assert abs((pii.likelihood(more, moves, labels)[0] - value) / 1e-6 - by_word[t, k]) < 1e-4
    for a, b in ((0, 1), (1, 2), (3, 0)):
        more = moves.copy()
        more[a, b] += 1e-6
        assert abs((pii.likelihood(scores, more, labels)[0] - value) / 1e-6 - by_move[a, b]) < 1e-4


def test_field_learns_its_table_and_finds_the_like(field):
    for sentence in pii.SENTENCES.strip().split("\n"):
        text, spans = pii.marked(sentence)
        (_, got), = pii.find([text], field)
        assert [(pii.KINDS[k], text[s:e]) for k, s, e in got] == sorted(((k, text[s:e].strip('"')) for k, s, e in spans), key=lambda x: pii.KINDS.index(x[0])), sentence
    unseen = {
        "please ring (415) 555-2671 soon": [("phone", "(415) 555-2671")],
        'here token = "0b5e2f7a9c3d4e6f8a1b2c3d4e5f60718293a4b5" ends': [("secret", "0b5e2f7a9c3d4e6f8a1b2c3d4e5f60718293a4b5")],
        "Dear Sophie, as agreed": [("name", "Sophie")],
        "Mr. Henry Adams left early": [("name", "Henry Adams")],
        "her SSN 321-54-9876 is known": [("number", "321-54-9876")],
        "write anna(at)example.net now": [("email", "anna(at)example.net")],
        "in 1875 and 1990 some 45 of 90 came": [],
        "on 2021-11-03 at 12:45, room 7": [],
        "no numbers at all, Dr is a title": [],
    }
    for text, want in unseen.items():
        (_, got), = pii.find([text], field)
        assert [(pii.KINDS[k], text[s:e]) for k, s, e in got] == want, text


def test_patterned_spans_stay_and_added_ones_do_not_overlap(field):
    rng = random.Random(9)
    pieces = ["+1 (499) 555-6503", "a@b.com", "1.2.3.4", "4713332104704538", "word", "Mr. John Smith", "\n", "12", "token", "=", '"9f86d081884c7d659a2feaa0c55ad015"', "(499) 555-6503"]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    for text, (base, spans) in zip(texts, pii.find(texts, field)):
        assert base == brute_base(text) and set(base) <= set(spans)
        added = sorted(set(spans) - set(base), key=lambda x: x[1])
        assert all(e <= s or v <= u for _, s, v in added for _, u, e in base)
        assert all(a[2] <= b[1] for a, b in zip(added, added[1:]))


def test_personal_data_frame(spark):
    got = pii.personal_data(odd(spark), keep=("doc_id", "spans", "value")).collect()
    assert len(got) == 7 and all(r.spans == "" and r.n_email == 0 and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in got)
    text = "é a@b.co 1.2.3.4 +1 (499) 555-6503 Dear Anna, pay 4713332104704538"
    r = pii.personal_data(docs(spark, [(text, "en", "s")])).first()
    base = brute_base(text)
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    assert r.base_sha256 == hashlib.sha256(pii.told(base).encode()).hexdigest() and r.spans == pii.told(base) + f",name:{text.index('Anna')}:{text.index('Anna') + 4}"
    assert pii.personal_data(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        pii.fit(pii.labelled_table(spark), rows=3)


# ---------------------------------------------------------------- 8

SAYINGS = """
License: MIT | mit
license = "MIT" | mit
"license": "MIT" | mit
see LICENSE file for details (MIT) | mit
The license is MIT. | mit
MIT License | mit
Licensed under the MIT license. | mit
SPDX-License-Identifier: MIT | mit
under the Expat License | mit
MPL-2.0 | mpl-2
MPL 2.0 | mpl-2
License: MPL-2.0 | mpl-2
licensed under MPL v2 | mpl-2
Mozilla Public License, v. 2.0 | mpl-2
EPL-2.0 | epl-2
EPL 1.0 | epl-1
License: EPL-2.0 | epl-2
Eclipse Public License 2.0 | epl-2
GNU GPL | gpl
GPLv3 | gpl-3
GPL-2.0-only | gpl-2
License: GPL-3.0-or-later | gpl-3
GNU General Public License version 2 | gpl-2
GNU General Public License | gpl
licensed under LGPL-2.1 | lgpl-2.1
LGPL 2.1 | lgpl-2.1
LGPL-3.0 | lgpl-3
LGPL | lgpl
GNU LGPL v2 | lgpl-2
GNU Lesser General Public License 2.1 | lgpl-2.1
AGPL-3.0 | agpl-3
GNU Affero General Public License | agpl
Creative Commons BY-NC-SA 4.0 | cc-by-nc-sa
Creative Commons BY 4.0 | cc-by
CC BY-SA 4.0 | cc-by-sa
CC-BY-ND 3.0 | cc-by-nd
CC0 1.0 | cc0
Creative Commons Attribution 4.0 International | cc-by
Apache License, Version 2.0 | apache-2
license: Apache-2.0 | apache-2
Apache 2.0 | apache-2
licensed under Apache | apache
licensed under ASL 2.0 | apache-2
BSD-3-Clause | bsd-3
License: BSD-3-Clause | bsd-3
License: BSD-2-Clause | bsd-2
3-clause BSD license | bsd-3
BSD license | bsd
license: BSD | bsd
License: ISC | isc
ISC License | isc
license: Zlib | zlib
zlib/libpng license | zlib
Boost Software License 1.0 | bsl-1
license: BSL-1.0 | bsl-1
The Unlicense | unlicense
license: Unlicense | unlicense
WTFPL | wtfpl
license: CC0-1.0 | cc0
license: CC-BY-4.0 | cc-by
license: CC-BY-NC-4.0 | cc-by-nc
SIL Open Font License 1.1 | ofl-1.1
license: OFL-1.1 | ofl-1.1
Artistic License 2.0 | artistic-2
license: Artistic-2.0 | artistic-2
European Union Public Licence 1.2 | eupl-1.2
license: EUPL-1.2 | eupl-1.2
Microsoft Public License | ms-pl
license: MS-PL | ms-pl
Python Software Foundation License | psf-2
PHP License 3.01 | php-3
license: PHP-3.01 | php-3
Ruby License | ruby
PostgreSQL License | postgresql
license: PostgreSQL | postgresql
OpenSSL License | openssl
University of Illinois/NCSA Open Source License | ncsa
license: NCSA | ncsa
Academic Free License 3.0 | afl-3
license: AFL-3.0 | afl-3
Open Software License 3.0 | osl-3
Universal Permissive License 1.0 | upl-1
license: UPL-1.0 | upl-1
Open Database License | odbl
license: ODbL-1.0 | odbl
W3C Software License | w3c
license: W3C | w3c
Vim License | vim
X11 License | x11
license: X11 | x11
GNU Free Documentation License | fdl
license: GFDL-1.3-only | fdl-1.3
Common Development and Distribution License 1.0 | cddl-1
license: CDDL-1.0 | cddl-1
Common Public License 1.0 | cpl-1
Perl Artistic License | artistic-1
MIT No Attribution | mit-0
license: MIT-0 | mit-0
Apache Software License 1.1 | apache-1.1
All rights reserved. | proprietary
in the public domain | public-domain
proprietary and confidential | proprietary
free of charge and simple | 
the committee met under the bridge | 
simple examples of 2 replies | 
"""


def test_what_people_write_about_licenses(spark):
    said = [tuple(x.strip() for x in line.rsplit(" |", 1)) for line in SAYINGS.strip("\n").split("\n")]
    assert len(said) > 100
    got = {r.doc_id: r.labels for r in licenses.scan(docs(spark, [(f"Some words. {t} More words.", "en", "s") for t, _ in said])).collect()}
    assert [(t, want, got[i]) for i, (t, want) in enumerate(said) if got[i] != want] == []


def test_every_rule_passes_the_gate(spark):
    """A text made from each rule's pattern, at its shortest, is found by that rule's label or one that covers it."""
    from re import _constants as c
    from re import _parser as p

    def shortest(items):
        out = ""
        for op, arg in items:
            if op is c.LITERAL:
                out += chr(arg)
            elif op is c.IN:
                kind, value = arg[0]
                out += chr(value) if kind is c.LITERAL else chr(value[0]) if kind is c.RANGE else "a"
            elif op is c.BRANCH:
                out += shortest(arg[1][0])
            elif op is c.SUBPATTERN:
                out += shortest(arg[3])
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
                out += shortest(arg[2]) * arg[0]
        return out

    # a clause may ask for its keyword elsewhere in the text
    made = [(f"{rule[4]} words {shortest(p.parse(rule[6]))}", rule[1]) for rule in licenses.rules()]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, [(f"words {t} words", "en", "s") for t, _ in made])).collect()}
    lost = [(t, label) for i, (t, label) in enumerate(made) if not got[i].labels]
    assert not lost, "\n".join(f"LOST {label}: {t[:60]}" for t, label in lost)
    assert sum(label in got[i].labels.split(",") for i, (_, label) in enumerate(made)) > 0.95 * len(made)


# ---------------------------------------------------------------- 2


def test_url_keys_of_urls_with_line_ends(spark):
    from pyspark.sql import functions as F

    urls = {"http://a.com/x y\r\nX: 1": "com,a)/x%20y%20%20x:%201", "http://a.com/p#f\ng": "com,a)/p", "http://www.B.a.com:80/X?q=1#f": "com,a,b)/x?q=1", None: ""}
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select("url", warc.url_key(F.col("url")).alias("k")).collect()
    assert {r.url: r.k for r in rows} == urls


def test_vectors_of_short_texts_come_a_few_rows_at_a_time():
    import pyarrow as pa

    texts = ["", None, "abc déf", "the cat"] * 300
    runs = list(langid.vectors(pa.array(texts, pa.string())))
    assert max(len(counts) for _, counts, _ in runs) <= langid.ROWS_TOGETHER
    assert [a for a, _, _ in runs] == list(range(0, len(texts), langid.ROWS_TOGETHER))
    (_, whole, sizes), = langid.vectors(pa.array(texts[:4], pa.string()))
    assert (np.concatenate([counts for _, counts, _ in runs]) == np.tile(whole, (300, 1))).all()
    assert np.concatenate([size for _, _, size in runs]).tolist() == sizes.tolist() * 300


def test_long_pieces_are_not_remembered():
    import public_tokenizers

    e = bpe.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    text = "short " + "xq" * 5000 + " short"
    ids, = e.encode([text])
    assert e.memo and max(map(len, e.memo)) <= 64
    assert e.encode([text, text]) == [ids, ids] and e.decode(ids).decode() == text


def test_language_stage_sends_each_text_once(spark):
    rows = [(k, t, "en", k) for k, t in enumerate(["the cat sat on the mat and the dog lay by the door"] * 40 + [None, "", "123"])]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, `a.b` int")
    found = corpus_pipeline.identify_language(spark, d, "")
    assert "_text" not in found._jdf.queryExecution().toString()
    assert found.schema == d.schema
    assert sorted(map(tuple, found.collect())) == rows[:40]
