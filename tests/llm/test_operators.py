"""Each corpus operator against brute force, and over nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest

pytest.importorskip("pageloom.llm")
from pyspark.sql import functions as F  # noqa: E402

from pageloom.llm import captures, licences, media, mixing, near_copies, packing, private_terms, quality_lines, site_quality, token_counts  # noqa: E402
from pageloom.llm.queries import tokenizer  # noqa: E402
from pageloom.llm.tokens import ByteBpe, WordBpe  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, kept string, k int, __s string, bucket int"
PROSE = "The report was read by all of them and it is of use to those who work there. " * 6


@pytest.fixture(scope="module")
def docs(spark):
    """Odd rows, with columns that the operators use inside."""
    rng = random.Random(5)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    texts = [None, "", " \n\t ", "one", "one two", PROSE, PROSE, PROSE.replace("report", "paper"), "x" * 30_000, "Ünï ©ode ﬁ 😀 don't <|endoftext|> we'll", "# $ % " * 100, "line\nline\nline\n" * 40, " ".join(rng.choice(words) for _ in range(5000))]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 90))) for _ in range(40)]
    rows = [(k, t, "en" if k % 3 else None, f"s{k % 4}" if k % 5 else None, len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, PROSE, "en", "s1", 1), (None, None, None, None, None)]
    return spark.createDataFrame([(*r, 7, "x", 1, "y", 2) for r in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, int(k not in (10, 11)), 0) for k in range(5, 30)] + [(None, 1, 0), (3, None, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")


def texts_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def key(rows):
    return sorted(rows, key=repr)


# 1


def brute_counts(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines, seen, dup = t.split("\n"), set(), 0
    for x in lines:
        dup += bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in seen
        seen.add(x)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = {g for g in grams if grams.count(g) > 1} if len(grams) < 600 else {g for g, n in __import__("collections").Counter(grams).items() if n > 1}
    cover = {i + j for i, g in enumerate(grams) if g in many for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)


def test_line_quality(spark, docs, none, labels):
    model = quality_lines.fitted(docs, labels)
    got = quality_lines.quality_rules(docs, model).collect()
    assert key([(r.doc_id, *r[1:6]) for r in got]) == key([(i, *brute_counts(t)) for i, t in texts_of(docs)])
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    assert quality_lines.quality_rules(none, model).count() == 0
    lines = quality_lines.line_labels(docs, model)
    assert lines.where("line is null or is_content is null").count() == 0
    assert quality_lines.fitted(none, labels)[0].shape == quality_lines.START.shape


def test_verdicts_by_brute_force(spark):
    """Every label sequence of short texts is tried."""
    rng = random.Random(3)
    kinds = ["the old house stood by the river and nobody knew who had built it there.", "HOME | NEWS | ABOUT", "BUY NOW!! HURRY!! WIN!! BIG!!", "### $$$ %%%", "ja", "", "a a a a a a a a b", "12 34 56 x"]
    texts = ["\n".join(rng.choice(kinds) for _ in range(rng.randint(1, 9))) for _ in range(60)] + ["\n".join([kinds[0]] * 2 + [f"{k} {kinds[0]}" for k in range(5)])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = np.random.default_rng(2).normal(size=len(quality_lines.FEATURES)), 0.7
    for r in quality_lines.quality_rules(df, model).collect():
        lines, seen, on, sizes = texts[r.doc_id].split("\n"), set(), [], []
        for line in lines:
            if line.split():
                on.append(quality_lines.line_features(line.split(), line, line in seen))
                sizes.append(len(line.split()))
                seen.add(line)
        n = len(on)
        value = lambda y: sum(model[0][f].sum() for i, f in enumerate(on) if y >> i & 1) + sum(0.7 for i in range(n - 1) if (y >> i & 1) == (y >> i + 1 & 1))  # noqa: B023, E731
        best = max(range(1 << n), key=value)
        content = sum(w for i, w in enumerate(sizes) if not best >> i & 1)
        assert (r.n_lines, r.n_boilerplate_lines, r.n_content_words) == (n, best.bit_count(), content)
        assert r.kept == (not r.base_failed and content >= quality_lines.CONTENT_SHARE * sum(sizes))


def test_spread_lines_and_fit(spark):
    rng = random.Random(7)
    prose = lambda: " ".join(rng.choice("the old house by river was sold in spring of that year and nobody came".split()) for _ in range(rng.randint(9, 30))) + "."
    texts = [[prose() for _ in range(rng.randint(2, 6))] for _ in range(40)]
    for k, t in enumerate(texts):
        if k % 3 == 0:
            t.insert(rng.randrange(len(t)), "Share | Print | Mail")
    texts += [texts[1]] * 9 + [[f"BUY {k}!! NOW!! HERE!! CHEAP!!" for k in range(5)] + [prose()] for _ in range(12)] + [["x" * 30_000, "", "  "]]
    df = spark.createDataFrame([(k, "\n".join(t), "x") for k, t in enumerate(texts)] + [(900, None, "x")], "doc_id long, text string, h string").repartition(3)
    labels = spark.createDataFrame([(k, int("BUY" not in t[0])) for k, t in enumerate(texts) if k % 4], "doc_id long, quality int")
    around: dict = {}
    for t in texts:
        for i, line in enumerate(t):
            around.setdefault(line, set()).add((t[i - 1] if i else "", t[i + 1] if i + 1 < len(t) else ""))
    sample = quality_lines.labelled_sample(df, labels, "quality", 1000)
    got = {(r.doc_id, r.line_no) for r in quality_lines.spread_lines(df.select("doc_id", "text"), sample).collect()}
    assert got == {(k, i) for k, t in enumerate(texts) if k % 4 for i, line in enumerate(t) if line.split() and len(around[line]) >= quality_lines.SPREAD} and got
    model = quality_lines.fitted(df, labels)
    seen = {(r.doc_id, r.line_no): r.is_content for r in quality_lines.line_labels(df, model).collect()}
    right = [c == ("|" not in texts[k][i] and "BUY" not in texts[k][i]) for (k, i), c in seen.items() if k < 900 and len(texts[k][i]) < 1000]
    assert sum(right) > 0.95 * len(right)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for n in range(1, 8):
        s, t = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))
        best = max(((sum(s[i, y >> i & 1] for i in range(n)) + sum(t[y >> i & 1, y >> (i + 1) & 1] for i in range(n - 1))), [y >> i & 1 for i in range(n)]) for y in range(1 << n))
        assert quality_lines.viterbi(s, t) == best[1]
    assert quality_lines.viterbi(np.zeros((0, 2)), np.zeros((2, 2))) == [] and quality_lines.viterbi(np.zeros((3, 2)), np.zeros((2, 2))) == [0, 0, 0]


# 2


def test_mixing(spark, docs, none):
    out = mixing.mix(docs)
    assert mixing.mix(none).count() == 0
    counted = out.groupBy("doc_id", "text", "__copy").count().collect()
    assert counted
    rates = {r["__s"]: r["__rate"] for r in mixing.rates(docs).collect()}
    want = {}
    for r in docs.collect():
        k = str(r.doc_id) if r.doc_id is not None else hashlib.md5((r.text or "").encode()).hexdigest()
        u = int(hashlib.md5(f"{mixing.SEED}:{k}".encode()).hexdigest()[:13], 16) / 2**52
        lam, p, n = rates[r.source], np.exp(-rates[r.source]), 0
        c = p
        while c <= u and n < 64:
            n += 1
            p *= lam / n
            c += p
        want[(r.doc_id, r.text)] = want.get((r.doc_id, r.text), 0) + n
    have = {}
    for r in out.collect():
        have[(r.doc_id, r.text)] = have.get((r.doc_id, r.text), 0) + 1
    assert have == {k: v for k, v in want.items() if v}
    given = {r["__s"]: r["__rate"] for r in mixing.rates(docs, {"s1": 3.0, "s2": 1.0, "s3": 0.0}, growth=2.0).collect()}
    sizes = {r.source: r["count"] for r in docs.groupBy("source").count().collect()}
    named = sizes["s1"] + sizes["s2"] + sizes["s3"]
    assert given["s3"] == 0 and given["s0"] == given[None] == 2.0 and abs(given["s1"] * sizes["s1"] - 2 * named * 0.75) < 1e-6
    assert {r["__rate"] for r in mixing.rates(docs, {}).collect()} == {1.0}


def test_mixing_names_and_order(spark):
    df = spark.createDataFrame([(k, "t" * (k % 3 * 40_000), "a", "x", "y") for k in range(300)], "doc_id long, text string, source string, __order string, __COPY string")
    out = mixing.mix(df)
    assert out.columns == [*df.columns, "___copy", "__copies", "___order"]
    got = [(r["___order"], r["___copy"]) for r in out.select("___order", "___copy").collect()]
    assert got == sorted(got) and len(got) > 200


def test_mixing_high_rates(spark):
    df = spark.createDataFrame([(k, f"t{k}", "a" if k < 3960 else "b") for k in range(4000)], "doc_id long, text string, source string")
    copies = {}
    for r in mixing.mix(df, {"a": 0.5, "b": 0.5}, shuffle=False).select("doc_id", "source").collect():
        copies.setdefault(r.source, []).append(r.doc_id)
    assert abs(len(copies["b"]) - 2000) < 4 * 2000**0.5 and abs(len(copies["a"]) - 2000) < 4 * 2000**0.5
    each = [copies["b"].count(k) for k in range(3960, 4000)]
    assert 0.4 < np.var(each) / np.mean(each) < 1.9

    def drawn(k):  # a rate of 50 is four draws of 12.5
        n = 0
        for head in ("", *(f"/draw-{i}" for i in (2, 3, 4))):
            u = int(hashlib.md5(f"{mixing.SEED}{head}:{k}".encode()).hexdigest()[:13], 16) / 2**52
            p = c = np.exp(-12.5)
            j = 0
            while c <= u:
                j += 1
                p *= 12.5 / j
                c += p
            n += j
        return n

    assert each == [drawn(k) for k in range(3960, 4000)]


# 3


def test_license_scan(spark, none):
    rows = [(1, "Some prose. Released under the MIT License. More prose."), (2, "Licensed under the Apache License, Version 2.0."), (3, "He lost his driving licence last year while moving between two houses."), (4, None), (5, ""), (5, "All rights reserved."), (6, "a " * 5000 + "\nThis work is licensed under the GNU General Public License, version 3.")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")
    got = {(r.doc_id, r.license) for r in licences.license_scan(df).where("confirmed").collect()}
    assert got == {(1, "MIT"), (2, "Apache-2.0"), (5, "Proprietary"), (6, "GPL-3.0")}
    for r in licences.license_scan(df).collect():
        assert dict(rows if r.doc_id != 5 else [(5, "All rights reserved.")])[r.doc_id][r.start :].startswith(r.block)
    assert licences.license_scan(none).count() == 0


PREAMBLE = "The editors thank all readers who sent in their remarks over so many years and hope that the volume serves them as well as the one before it did in the old house near the harbour wall, "


@pytest.fixture(scope="module")
def scanner():
    return licences.Scanner(licences.TEMPLATES)


def confirmed(scanner, text):
    return {x[0] for _, block in licences.blocks(text, scanner.longest) for x in scanner.scan(block) if x[-1]}


def test_license_wording(scanner):
    for name, notices in licences.TEMPLATES.items():
        for notice in notices:
            assert confirmed(scanner, notice) == {name} and confirmed(scanner, PREAMBLE + notice) == {name}, notice
    assert confirmed(scanner, "Copyright 2024 Foo Press, All rights reserved.") == {"Proprietary"}
    denied = ["Not released under the MIT License.", "This is never licensed under the Apache License, Version 2.0.", "Use it under terms other than the MIT License.", "It isn't released under the MIT License."]
    others = ["Released under the ISC Licence.", "Licensed under CC BY 2.0.", "Released under the BSD 4-Clause License.", "He gave a talk at MIT on the license of the river.", "Licensed under the Apache License, Version 1.1.", "This work is licensed under the GNU General Public License, version 3.1."]
    for t in denied + others:
        assert not confirmed(scanner, t), t
    assert confirmed(scanner, "Licensed under CC BY-NC-ND 4.0.") == {"CC-BY-NC-ND-4.0"} and confirmed(scanner, "# SPDX-License-Identifier: MIT") == {"MIT"}
    assert confirmed(scanner, "Released under the MIT License and licensed under the Apache License, Version 2.0.") == {"MIT", "Apache-2.0"}
    assert confirmed(scanner, "All code here is\n * released under the GNU General Public\n * License, version 3.") == {"GPL-3.0"}
    long = "word " * 4000 + "is released under the MIT License " + "and more " * 4000
    assert confirmed(scanner, long) == {"MIT"} and not confirmed(scanner, "so " * 9000 + "the license")


def test_license_ranks_and_differences(scanner):
    """All templates are ranked by what they save, by a plain compressor; differences are those of the words."""
    import zstandard as z

    plain = {"level": 19, "write_content_size": False, "write_checksum": False}
    for text in ("It is Released under the MIT License.", "Licensed under the GNU General Public License version 3", "Licensed under CC BY-SA 4.0 today", "the copyright is theirs"):
        size = lambda t: len(z.ZstdCompressor(**plain, **({"dict_data": z.ZstdCompressionDict(t.encode(), dict_type=z.DICT_TYPE_RAWCONTENT)} if t else {})).compress(text.encode()))  # noqa: B023, E731
        saved = {n: max((size("") - size(t)) / len(t) for t in ts) for n, ts in licences.TEMPLATES.items()}
        for name, saving, rank, n, differ, ok in scanner.scan(text):
            assert n == len(differ) and saving <= saved[name] + 0.05 and (ok or rank == 1)
    assert scanner.scan("Licensed under the GNU General Public License version 3")[0][3:] == (2, ["-this", "-work"], True) or scanner.scan("Licensed under the GNU General Public License version 3")[0][5]
    assert scanner.scan("Released under an MIT License.")[0][3:5] == (1, ["-the+an"])


def test_wrapped_license_notices(scanner):
    for name, notices in licences.TEMPLATES.items():
        words = notices[0].split()
        for k in range(1, len(words)):
            for line in ("\n", "\r\n", "\n    ", "\n# ", "\n * "):
                text = "Ünï 😀 head\n\n" + " ".join(words[:k]) + line + " ".join(words[k:]) + "\n\nOther prose."
                found = list(licences.blocks(text, scanner.longest))
                assert all(text[start:].startswith(block) for start, block in found)
                assert confirmed(scanner, text) == {name}, text
    for k in range(1100, 1400, 7):
        assert not confirmed(scanner, "a " * (k // 2) + "b" * (k % 2) + " This work is licensed under the GNU General Public License, version 3.1 " + "c " * 1500)


# 4


def test_token_counts(spark, docs, none):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    n = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    got = token_counts.token_counts(docs, path, limit=20).collect()
    assert key([(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got]) == key([(i, len(t.encode()), n(t), n(t) > 20) for i, t in texts_of(docs)])
    assert token_counts.token_counts(none, path).count() == 0
    model = WordBpe(path)
    for t in ("It'll don't we're  x 12 a_b ...", "Größe über alles's", "Ünï ﬁ <|endoftext|> b", "", "\n"):
        assert model.every_prefix(t) == [n(t[:k]) for k in range(len(t) + 1)]
    some = docs.where("length(text) < 200")
    table = token_counts.prefix_counts(some, path)
    for r in table.select(token_counts.count_at(F.col("prefix_tokens"), 7).alias("c"), token_counts.within_budget(F.col("prefix_tokens"), 3).alias("w"), "prefix_tokens").collect():
        p = r.prefix_tokens
        assert r.c == p[min(7, len(p) - 1)] and r.w == max(k for k, c in enumerate(p) if c <= 3)
    fit = {(r.doc_id, r.n_bytes): r.fit_chars for r in got}
    for i, t in texts_of(docs):
        if len(t) < 3000:
            assert fit[i, len(t.encode())] == max(k for k in range(len(t) + 1) if n(t[:k]) <= 20)


def test_prefixes_of_mixed_scripts():
    import time

    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    lib, model, rng = Tokenizer.from_file(path), WordBpe(path), random.Random(1)
    n = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    letters = "abcdefghij'stdmrlvé ÉßüÑ  \n\t.,!#_0129-🙂中́İΣς字日本語кириллицаابعदेа́ <|endoftext|>ﬁ½²\ua7cb\u200d"
    words = "the running internationalisation ththththth xxxxxxxxx größenwahn don't we'll it's ''s !'s n't 中文字符 привет हिन्दी <|endoftext|> a<|endoftext|>b".split()
    for k in range(800):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) if k % 2 else rng.choice([" ", "", "  "]).join(rng.choice(words) for _ in range(rng.randint(1, 6)))
        want = [n(t[:k]) for k in range(len(t) + 1)]
        assert model.every_prefix(t) == want and model.count(t) == want[-1], t
        for budget in (0, 1, 3, 7):
            assert model.longest_prefix(t, budget) == max(k for k, c in enumerate(want) if c <= budget), t
    for word in ("x" * 8000, "".join(rng.choice("abcdefgh") for _ in range(8000)), "中" * 4000, "ab-" * 2000):
        began = time.time()
        got = model.every_prefix(word)
        assert time.time() - began < 2 and got[-1] == n(word) and got[777] == n(word[:777])


def test_pieces_have_the_librarys_ids():
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(tokenizer("byte_bpe_50k.json")), ByteBpe(tokenizer("byte_bpe_50k.json"))
    words, own_words = Tokenizer.from_file(tokenizer("word_bpe_49k.json")), WordBpe(tokenizer("word_bpe_49k.json"))
    rng = random.Random(3)
    letters = "abcdefghij'stdmrlvé ÉßüÑ  \n\t.,!#_0129-🙂中́"
    for _ in range(1500):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        assert np.frombuffer(own.ids(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids
        assert own_words.count(t) == len(words.encode(t, add_special_tokens=False).ids)


# 5


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(t):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, t):
            d = re.sub(r"\D", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def test_private_spans(spark, docs, none):
    rng = random.Random(9)
    parts = ["a.b@c.de", "x@y", "@z.com", "a@b.c_d@e.fg", "1.2.3.4.5.6.7.8", "300.1.1.1", "0255.01.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "+1 2", "+123456789", "😀é", "word", "5.5", " ", "\n", "+", "é@ü.com", "4111111111111111"]
    rows = [(i, t) for i, t in texts_of(docs)] + [(1000 + k, rng.choice(["", " ", "x "]).join(rng.choice(parts) for _ in range(rng.randint(1, 12)))) for k in range(150)]
    rows += [(5000 + k, f"note {k} {'abcdefghij'[k]}{k} write Quintus at q.max@mail.org {'zyxwvutsrq'[k]} soon") for k in range(8)] + [(6000, "the 9" * 20_000), (6001, "1" * 50_000), (6002, "a." * 30_000)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, e string, t int")
    got = private_terms.private_spans(df).collect()
    want = {(i, t): brute_spans(t) for i, t in rows}
    by_id = {}
    for i, t in rows:
        by_id.setdefault(i, set()).add(hashlib.sha256(",".join(f"{x[3]}:{x[0]}:{x[2]}" for x in want[i, t]).encode()).hexdigest())
    assert len(got) == len(rows) and all(r.base_sha256 in by_id[r.doc_id] for r in got)
    terms = {r.doc_id: r.spans for r in got if r.n_term}
    assert all(k in terms for k in range(5000, 5008)) and "term" not in "".join(r.spans for r in got if r.doc_id is not None and r.doc_id < 1000)
    assert private_terms.private_spans(none).count() == 0
    clean = {r.doc_id: r.text for r in private_terms.sanitise(df).collect()}
    assert "q.max" not in clean[5000] and "Quintus" not in clean[5000] and "<EMAIL>" in clean[5000]
    assert private_terms.sanitise(docs).columns == docs.columns and private_terms.sanitise(docs).count() == docs.count()
    assert private_terms.sanitise(docs).where("doc_id = 0 and text is not null").isEmpty()


def brute_terms(texts):
    """The disclosing terms of each text, straight from the docstring's formulas."""
    from math import log2

    spans = {t: brute_spans(t) for t in texts}
    rows = [t for t in texts if not spans[t]] + [t for t in set(texts) if spans[t]]  # copies of a text with an entity count once
    n = len(rows)

    def words(t):
        for s, _, e, _ in spans[t]:
            t = t[:s] + " " * (e - s) + t[e:]
        return {w.lower() for w in re.findall(r"[^\W\d_]\w{2,}", t)}

    of = {t: words(t) for t in set(rows)}
    every = {t: set(re.findall(r"[^\W\d_]\w{2,}", t.lower())) for t in set(rows)}
    entities = {t: {(k, t[s:e].lower()) for s, _, e, k in spans[t]} for t in set(rows)}
    out = {t: set() for t in set(rows)}
    for e in {e for x in entities.values() for e in x}:
        having = [t for t in rows if e in entities[t]]
        for w in {w for t in having for w in of[t]}:
            co, dt = sum(w in of[t] for t in having), sum(w in every[t] for t in rows)
            p = (min(co, dt) + private_terms.PRIOR * len(having) / n) / (dt + private_terms.PRIOR)
            if -log2(p) <= private_terms.LEFT_BITS and log2(p * n / len(having)) >= private_terms.LEAST_BITS:
                for t in having:
                    if w in of[t]:
                        out[t].add(w)
    return out


@pytest.mark.parametrize("broadcast", [True, False])
def test_disclosing_terms(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(private_terms, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(private_terms, "HOT", 2)
    rng = random.Random(12)
    common, rare = [f"word{k}" for k in range(30)], [f"Name{k}" for k in range(40)]
    texts = []
    for k in range(260):
        words = [rng.choice(common) for _ in range(rng.randint(3, 30))]
        for j in rng.sample(range(20), rng.choice((0, 0, 1, 2))):  # an entity brings a name along, most of the time
            words.insert(rng.randrange(len(words)), f"p{j}@mail.example.org" if j % 2 else f"10.0.0.{j}")
            words.insert(rng.randrange(len(words)), rare[j] if rng.random() < 0.9 else rng.choice(rare))
        texts.append(" ".join(words))
    texts += [texts[3]] * 5 + [next(t for t in texts if "@" in t)] * 6 + ["Solo met solo@mail.example.org"] * 9
    want = brute_terms(texts)
    assert sum(map(len, want.values())) > 20
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, words string").repartition(3)
    for r in private_terms.private_spans(df).collect():
        t = texts[r.doc_id]
        got = [x.split(":")[1:] for x in r.spans.split(",") if x.startswith("term")]
        assert {t[int(a) : int(b)].lower() for a, b in got} == want[t] and r.n_term == len(got)
        assert len(got) == sum(len(re.findall(rf"(?<!\w){w}(?!\w)", t.lower())) for w in want[t])
    for r in private_terms.sanitise(df).collect():
        assert not (want[texts[r.doc_id]] & set(re.findall(r"\w+", r.text.lower()))) and "@" not in r.text


def test_dense_text(spark):
    import time

    text = " ".join(f"user{k}@mail{k % 7}.example.com" for k in range(20_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    r = private_terms.private_spans(df).first()
    assert r.n_email == 20_000 and r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in brute_spans(text)).encode()).hexdigest()
    assert private_terms.sanitise(df).first().text == " ".join(["<EMAIL>"] * 20_000) and time.time() - began < 120


# 6


def test_site_quality(spark, docs, none, labels):
    weights = site_quality.train(docs, labels)
    got = site_quality.site_quality(docs, weights)
    assert got.count() == docs.count() and got.where("quality is null or kept is null").count() == 0
    assert site_quality.site_quality(none, weights).count() == 0 and site_quality.train(none, labels) == list(site_quality.START)
    rows = [(k, "big", "a", 0.9 if k % 10 else 0.1) for k in range(1000)] + [(2000, "tiny", "a", 0.05)]
    shift = {r.h: r["shift"] for r in site_quality.posteriors(spark.createDataFrame(rows, "k int, h string, q string, p double"), "h", "q", "p").collect()}
    m = sum(r[3] for r in rows) / len(rows)
    assert abs(shift["big"]) < 0.1 and -np.log(m / (1 - m)) + np.log(0.05 / 0.95) < shift["tiny"] < 0
    assert site_quality.keep_good(docs, weights).columns == docs.columns


def test_site_posteriors_by_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(k, h, q, min(0.99, max(0.01, rng.gauss(0.2 + 0.15 * h + 0.05 * q, 0.1)))) for k in range(600) for h, q in [(rng.choice((0, 0, 0, 1, 2, 3)), rng.randrange(3))]]
    rows = [(k, None if h == 3 else f"h{h}", None if q == 2 else f"q{q}", p) for k, h, q, p in rows]
    got = {(r.h, r.q): (r.n, r["shift"]) for r in site_quality.posteriors(spark.createDataFrame(rows, "k int, h string, q string, p double"), "h", "q", "p").collect()}
    n, m = len(rows), sum(r[3] for r in rows) / len(rows)
    of = lambda *c: {k: [r[3] for r in rows if tuple(r[i] for i in c) == k] for k in {tuple(r[i] for i in c) for r in rows}}
    hosts, paths = of(1), of(1, 2)

    def strength(groups, center):
        between = sum(len(v) * (np.mean(v) - center(k)) ** 2 for k, v in groups.items()) / n
        return min(max(m * (1 - m) / max(between - m * (1 - m) * len(groups) / n, 1e-9) - 1, 5.0), 1000.0)

    kh, kp = strength(hosts, lambda k: m), strength(paths, lambda k: np.mean(hosts[k[:1]]))
    for k, v in paths.items():
        host = (sum(hosts[k[:1]]) + kh * m) / (len(hosts[k[:1]]) + kh)
        mean = (sum(v) + kp * host) / (len(v) + kp)
        assert got[k][0] == len(v) and np.isclose(got[k][1], np.log(mean / (1 - mean)) - np.log(m / (1 - m)))
    # verdicts: own evidence plus the site's shift; both ways of the join, hosts and paths by address
    texts = ["the old house by the river was sold in the spring of that year", "### $$$ %%% &&& ###", "", None, "A B C !!! !!!"]
    docs = spark.createDataFrame([(k, texts[k % 5], f"https://WWW.Site{k % 4}.example.org:80/{'abc'[k % 3]}/p{k}?q=/z/" if k % 7 else None, "x", "y") for k in range(80)], "doc_id long, text string, url string, site string, row string")
    weights = list(site_quality.START)
    first = site_quality.site_quality(docs, weights, url="url").collect()
    assert {r.host for r in first} == {None, *(f"site{k}.example.org" for k in range(4))} and {r.path for r in first} == {None, "a", "b", "c"}
    logit = {r.text: r.v for r in site_quality.measured(docs.select("text", F.col("text").alias("t"))).select("text", site_quality.evidence(weights).alias("v")).collect()}
    shift = {(r.h, r.q): r["shift"] for r in site_quality.posteriors(spark.createDataFrame([(r.host, r.path, float(1 / (1 + np.exp(-r.evidence)))) for r in first], "h string, q string, p double"), "h", "q", "p").collect()}
    for r in first:
        assert np.isclose(r.evidence, logit[texts[r.doc_id % 5]]) and np.isclose(r.site_shift, shift[r.host, r.path])
        assert np.isclose(r.quality, 1 / (1 + np.exp(-(r.evidence + site_quality.SITE_WEIGHT * r.site_shift)))) and r.kept == (r.quality >= site_quality.KEEP)
    monkeypatch.setattr(site_quality, "BROADCAST_ROWS", 0)
    assert key(site_quality.site_quality(docs, weights, url="url").collect()) == key(first)
    assert {r.doc_id for r in site_quality.keep_good(docs, weights, url="url").collect()} == {r.doc_id for r in first if r.kept}


def test_features_by_brute_force(spark):
    texts = [PROSE, "# $ % 12 AB !? |", "", "x", "Ünï Äß\t\nyes yes yes " * 9]
    got = site_quality.measured(spark.createDataFrame([(t,) for t in texts], "t string").withColumn("key", F.col("t"))).select("key", F.array(*(f.cast("double") for f in site_quality.features())).alias("f")).collect()
    for r in got:
        t, words = r.key, [w for w in re.split("[ \t-\r]+", r.key) if w]
        n, d, c = max(len(words), 1), len(set(words)), max(len(t), 1)
        share = lambda of, x=1.0: min(1.0, sum(t.count(s) for s in of) / c * x)
        want = [min(1, np.log(n + 1) / 8), share(site_quality._SYMBOLS, 5), share("|", 10), share("!?", 5), share("0123456789", 3), share(site_quality._CAPITALS, 1.5), d / n, np.log(d + 1) / np.log(n + 1) if n > 20 else 1.0, min(1, c / n / 20)]
        assert np.allclose(r.f, want), t


def test_labelled_sample_is_bounded(spark):
    from pageloom.llm.shared import labelled_sample

    docs = spark.createDataFrame([(1, f"copy {k}", 0) for k in range(500)] + [(k, "w" * 30_000, 0) for k in range(2, 9)], "doc_id long, text string, y int")
    labels = spark.createDataFrame([(k, k % 2) for k in range(9)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = labelled_sample(docs, labels, "quality", 4).collect()
    assert len(got) <= 4 and len({r.doc_id for r in labelled_sample(docs, labels, "quality", 100).collect()}) == 8
    assert all(len(r.text) == 30_000 for r in got if r.doc_id != 1)


# 7


def brute_components(fps):
    up = {k: k for k in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(fps, 2):
        if (a ^ b).bit_count() <= 2:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {k: root(k) for k in fps}


def test_fingerprints_and_components(spark, docs, none, monkeypatch):
    monkeypatch.setattr("pageloom.llm.shared.HOT", 2)  # both ways of the last join
    got = near_copies.near_copies(docs).collect()
    fps = {}
    for r in got:
        fps.setdefault(int(r.fingerprint, 16), []).append(r.doc_id)
    for i, t in texts_of(docs):
        assert i in fps[near_copies.fingerprint(t)]
    roots = brute_components(list(fps))
    least = {}
    for f, ids in fps.items():
        least.setdefault(roots[f], []).extend(i for i in ids if i is not None)
    for r in got:
        assert r.component_id == min(least[roots[int(r.fingerprint, 16)]], default=None)
    assert near_copies.near_copies(none).count() == 0
    left = near_copies.one_of_each(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted({r.component_id for r in got})
    rows = [(1, "P", 0), (2, "P", 0), (2, "Q", 0), (3, "R", 1), (3, "R", 1), (None, "S", 2), (None, "S", 3), (4, "P", 0), (None, "R", 1), (5, PROSE * 40, 1), (6, PROSE * 40, 2)]
    some = spark.createDataFrame([(*r, "x", {"k": r[2]}) for r in rows], "doc_id long, text string, n int, __a string, root map<string,int>")
    for how in ({}, {"similarity": 0.8, "width": 5}):
        once = near_copies.one_of_each(some, **how)
        assert key([(r.doc_id, r.text[:1]) for r in once.collect()]) == key([(1, "P"), (2, "Q"), (3, "R"), (None, "S"), (5, "T")]) and once.columns == some.columns


def brute_fingerprint(t):
    import xxhash

    words = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), t or ""))
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint(docs):
    for _, t in texts_of(docs):
        assert near_copies.fingerprint(t) == brute_fingerprint(t)


def test_copies_by_similarity(spark, none, monkeypatch):
    rng = random.Random(8)
    base = [[f"w{rng.randrange(5000)}" for _ in range(rng.randint(40, 300))] for _ in range(12)]
    texts = [None, "", "one", "ONE", "one two"]
    for words in base:
        for _ in range(15):
            edited = list(words)
            for _ in range(rng.randint(0, len(words) // 20)):
                edited[rng.randrange(len(edited))] = f"e{rng.randrange(5000)}"
            texts.append(" ".join(edited))
    for words in base[:4]:  # chains of edits, whose ends are far from each other
        for _ in range(25):
            words = list(words)
            for _ in range(len(words) // 60 + 1):
                words[rng.randrange(len(words))] = f"c{rng.randrange(5000)}"
            texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def sets(t):
        w = (t or "").lower().split()
        return {" ".join(w[k : k + 5]) for k in range(max(len(w) - 4, min(len(w), 1)))}

    root = list(range(len(texts)))
    of = [sets(t) for t in texts]
    for a, b in combinations(range(len(texts)), 2):
        if of[a] == of[b] == set() or (of[a] and len(of[a] & of[b]) / len(of[a] | of[b]) >= 0.8):
            root = [min(root[a], root[b]) if x in (root[a], root[b]) else x for x in root]
    assert len(set(root)) < len({near_copies.fingerprint(t) for t in texts})
    for pairs in (near_copies.PAIRS, 2):  # also with centres dealt out to several tasks
        monkeypatch.setattr(near_copies, "PAIRS", pairs)
        got = {r.doc_id: r.component_id for r in near_copies.similar_copies(df, 5, 0.8).collect()}
        assert [got[k] for k in range(len(texts))] == root
    assert {r.doc_id for r in near_copies.one_of_each(df, 5, similarity=0.8).collect()} == set(root)
    assert near_copies.similar_copies(none, 5, 0.8).count() == 0


def five_word_similarity(texts):
    of = [{tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} for w in (t.split() for t in texts)]
    return lambda a, b: len(of[a] & of[b]) / len(of[a] | of[b])


def test_fingerprints_and_similarity_in_one_graph(spark):
    """With `ring`, a pair is linked by its fingerprints' distance or by its sets' similarity."""
    rng = random.Random(8)
    texts = ["red green blue " * 60 + f"tail{k} of it" for k in range(4)]  # equal fingerprints nearly, sets unlike
    for _ in range(4):  # sets alike, fingerprints often not
        words = [f"w{rng.randrange(5000)}" for _ in range(120)]
        for _ in range(12):
            edited = list(words)
            for _ in range(rng.randint(0, 3)):
                edited[rng.randrange(120)] = f"e{rng.randrange(5000)}"
            texts.append(" ".join(edited))
    like, fps = five_word_similarity(texts), [near_copies.fingerprint(t) for t in texts]
    root, by = list(range(len(texts))), set()
    for a, b in combinations(range(len(texts)), 2):
        how = ((fps[a] ^ fps[b]).bit_count() <= 2, like(a, b) >= 0.8)
        by.add(how)
        if any(how):
            root = [min(root[a], root[b]) if x in (root[a], root[b]) else x for x in root]
    assert {(True, False), (False, True)} <= by
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_copies.similar_copies(df, 5, 0.8, ring=3).collect()}
    assert [got[k] for k in range(len(texts))] == root
    assert {r.doc_id for r in near_copies.one_of_each(df, 5, similarity=0.8, ring=3).collect()} == set(root)
    assert near_copies.similar_copies(df.where("false"), 5, 0.8, ring=3).count() == 0


def rows_of_joins(plan, key):
    """Rows that the joins by `key` made, in the plan that ran."""
    name = plan.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        kids = [plan.executedPlan()]
    elif "QueryStage" in name:
        kids = [plan.plan()]
    else:
        kids = [plan.children().apply(k) for k in range(plan.children().size())]
    own = plan.metrics().apply("numOutputRows").value() if "Join" in name and key in plan.leftKeys().toString() else 0
    return own + sum(rows_of_joins(x, key) for x in kids)


def near_group(rng, n):
    """Texts near one another, many of them not near enough."""
    for _ in range(n):
        words = [f"w{k}" for k in range(150)]
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(150)] = f"e{rng.randrange(50000)}"
        yield " ".join(words)


def test_similar_links_meet_once(spark):
    """In a group of texts near one another the join makes links only, and each under one of the keys that it shares."""
    texts = sorted(set(near_group(random.Random(9), 300)))
    like, root = five_word_similarity(texts), list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        if like(a, b) >= 0.8:
            root = [min(root[a], root[b]) if x in (root[a], root[b]) else x for x in root]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    signed = near_copies.written(near_copies._signed(df, 5, "text"), "signed")
    found = near_copies.similar_links(df, signed, 5, 0.8, "text")
    keys = dict(signed.rdd.map(lambda r: (r.key, r.doc_id)).collect())
    pairs = [(keys[r.a], keys[r.b]) for r in found.collect()]
    assert all(like(a, b) >= 0.8 for a, b in pairs)
    assert 0 < rows_of_joins(found._jdf.queryExecution().executedPlan(), "slot") <= len(texts)
    got = {r.doc_id: r.component_id for r in near_copies.similar_copies(df, 5, 0.8).collect()}
    assert [got[k] for k in range(len(texts))] == root


def test_links_of_crowded_and_other_keys(spark, monkeypatch):
    rng = random.Random(4)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps)[:12]:
        for _ in range(25):
            g = f
            for _ in range(rng.randint(1, 3)):
                g ^= 1 << rng.randrange(64)
            fps.add(g)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = {f: r for f, r in brute_components(list(fps)).items()}
    for bucket in (10_000, 3, 0):
        monkeypatch.setattr(near_copies, "BUCKET", bucket)
        edges = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in near_copies.links(df).collect()]
        assert all((a ^ b).bit_count() <= 2 for a, b in edges)
        if bucket == 10_000:
            assert {frozenset(e) for e in edges} == {frozenset(p) for p in combinations(fps, 2) if (p[0] ^ p[1]).bit_count() <= 2}
        found = {r.node & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in near_copies.components(near_copies.links(df)).collect()}
        groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
        whole = groups({f: found.get(f, f) for f in fps})
        assert whole == groups(want)


# 8


def test_packing(spark, docs, none):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    got = packing.pack(docs, path).toPandas()
    want = sorted((len(e) + 1, zlib.crc32(np.array([*e, 0], "<u4").tobytes())) for e in (lib.encode(t, add_special_tokens=False).ids for _, t in texts_of(docs)))
    assert got["length"].sum() == sum(n for n, _ in want)
    one = got[got["length"] == got["doc_tokens"]]
    assert set(zip(one["length"], one["ids_crc32"])) <= set(want)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 1024
    for _, g in got.dropna(subset=["doc_id"])[lambda x: x["doc_id"] != 5].groupby("doc_id"):
        g = g.sort_values("start")
        assert g["start"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() == g["doc_tokens"].iloc[0]
    assert packing.pack(none, path).count() == 0


def test_differencing():
    rng = random.Random(2)
    for _ in range(200):
        sizes, k = [rng.randint(1, 200) for _ in range(rng.randint(0, 60))], rng.randint(1, 9)
        parts = packing.difference(sizes, k)
        assert len(parts) == k and sorted(x for p in parts for x in p) == list(range(len(sizes)))
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in p) for p in packing.difference([8, 7, 6, 5, 4], 2)) == [14, 16]
    for p in packing.windows_of([700, 700, 700, 300]):
        assert sum([700, 700, 700, 300][i] for i in p) <= 1024
    for n in (1, 1023, 1024, 1025, 5000):
        pieces = list(packing.cuts(n))
        assert sum(s for _, s in pieces) == n and all(a + s == b for (a, s), (b, _) in zip(pieces, pieces[1:]))


# 9


def test_captures(spark):
    rows = [(k, f"http://www.H{k % 7}.org/{k % 3}?q#f", f"<p>{k % 5}</p>") for k in range(40)]
    rows += [(50, None, None), (51, "http://a.b/", ""), (52, "http://a.b/", "WARC/1.1\r\nContent-Length: 3\r\n\r\nx\r\n\r\né"), (None, "http://a.b/", "<p>1</p>"), (39, "http://z.z/", "<p>4</p>")]
    rows += [(53, "HTTPS://user@A.B:443/Long", "é<p>\r\n\r\n" * 40_000), (54, "no address", "x" * 300_000)]
    pages = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "page_id long, url string, html string, digest string, record string, bytes int")
    got = captures.capture_histories(pages).collect()
    import base64

    top, low = {}, {}
    for i, _, h in rows:
        if i is not None:
            top[h or ""] = max(top.get(h or "", -1), i)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        revisit = i is not None and i < top[h or ""]
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", top[h or ""] if revisit else None))
    assert key([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got]) == key(want)
    order = [(r.url_key, r.ts, r.page_id if r.page_id is not None else -1) for r in got]
    assert order == sorted(order) and any(r.url_key == "org,h3)/0?q" for r in got)
    assert captures.capture_histories(pages.where("false")).count() == 0
    assert len({r.archive for r in got}) > 1 and {r.url_key for r in got if r.page_id in (53, 54)} == {"b,user@a)/long", "no address)"}
    few = captures.capture_histories(pages, least=9)
    assert few.where("record_type = 'revisit' and payload_bytes < 9").count() == 0


def test_hot_payloads_beyond_a_broadcast(spark, monkeypatch):
    pages = spark.range(300).selectExpr("id as page_id", "concat('http://h/', id) as url", "case when id % 2 = 0 then null else concat('p', id % 40) end as html")
    want = key(captures.capture_histories(pages).select("page_id", "payload_digest", "record_type", "refers_to").collect())
    monkeypatch.setattr("pageloom.llm.shared.BROADCAST_ROWS", 3)
    monkeypatch.setattr("pageloom.llm.shared.HOT", 20)
    assert key(captures.capture_histories(pages).select("page_id", "payload_digest", "record_type", "refers_to").collect()) == want


def test_merge_over_ranges(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(captures, "RANGE_ROWS", 50)
    pages = spark.range(400).selectExpr("id as page_id", "concat('http://h', id % 3, '.org/') as url", "concat('p', id) as html")
    captures.write_archives(pages, str(tmp_path / "w"), per_archive=30)
    runs = captures.index_runs(spark, str(tmp_path / "w"))
    merged = captures.merge_index(runs)
    assert merged.rdd.getNumPartitions() > 4
    got = [(r.url_key, r.ts, r.page_id) for r in merged.collect()]
    assert got == sorted(got) and len(got) == 400 and runs.select("archive").distinct().count() > 10


def test_loser_tree():
    rng = random.Random(8)
    for k in range(0, 9):
        runs = [sorted(rng.randint(0, 20) for _ in range(rng.randint(0, 12))) for _ in range(k)]
        assert list(captures.loser_tree(runs)) == sorted(x for r in runs for x in r)


# 10


def test_media(spark, docs, none):
    got = media.text_media(docs, keep=True).collect()
    want = []
    for i, t in texts_of(docs):
        b = t.encode()
        p = b + b"\xff" * (max(1, -(-len(b) // 576)) * 576 - len(b))
        want.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert key([tuple(r[:5]) for r in got]) == key(want)
    assert all(r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest() for r in got)
    assert media.text_media(none).count() == 0
    import io

    assert all(np.load(io.BytesIO(r.npy)).shape == (16, 16) for r in got)


def brute_resize(a, height, width):
    """Means by the share of every source sample that a target sample covers."""
    h, w = a.shape
    cover = lambda n, m: np.array([[max(0.0, min((i + 1) * n / m, k + 1) - max(i * n / m, k)) for k in range(n)] for i in range(m)])
    return cover(h, height) @ a.astype(float) @ cover(w, width).T * height * width / (h * w)


def test_area_resize_and_features():
    rng = np.random.default_rng(5)
    for h, w in ((1, 24), (2, 3), (7, 5), (8, 24), (24, 24), (51, 24), (333, 24)):
        a = rng.integers(0, 256, (h, w), np.uint8)
        for height, width in ((16, 16), (8, 9), (3, 4)):
            assert np.allclose(media.area_resize(a, height, width), brute_resize(a, height, width))
        c = rng.integers(0, 256, (h, w, 3), np.uint8)
        for image in (a, c):
            tile, bits = media.tile_and_hash(image)
            grey = image if image.ndim == 2 else (image.astype(int) @ [299, 587, 114]) // 1000
            s = brute_resize(grey, 8, 9).round(6)
            assert tile == media.tile_of(image) and bits == media.difference_hash(image) == f"{int(''.join(str(int(s[i, j + 1] > s[i, j])) for i in range(8) for j in range(8)), 2):016x}"


def test_images(spark):
    rng = np.random.default_rng(0)
    a, c = rng.integers(0, 256, (7, 5), np.uint8), rng.integers(0, 256, (4, 6, 3), np.uint8)
    assert (media.decode(media.encode_pgm(a)) == a).all() and (media.decode(media.encode_ppm(c)) == c).all() and (media.decode(media.encode_bmp(c)) == c).all()
    assert (media.decode(b"P2 # note\n2 1\n255\n7 9") == [[7, 9]]).all() and (media.decode(b"P1\n3 1\n1 0 1") == [[0, 255, 0]]).all() and (media.decode(b"P4\n3 1\n\xa0") == [[0, 255, 0]]).all()
    assert media.decode(b"P3\n1 1\n15\n15 0 3").tolist() == [[[255, 0, 51]]]
    big = rng.integers(0, 256, (12, 8), np.uint8)
    assert np.allclose(media.area_resize(big, 3, 4), big.reshape(3, 4, 4, 2).mean((1, 3)))
    assert np.isclose(media.area_resize(a, 3, 2).mean(), a.mean())
    rows = spark.createDataFrame([(1, media.encode_pgm(a)), (2, b"P5 9 9 255\nx"), (3, None), (4, b"BM"), (5, b"GIF89a")], "id int, image binary")
    out = {r.id: r for r in media.tiles(rows, "id", "image").collect()}
    assert out[1].error is None and (out[1].width, out[1].height) == (5, 7) and all(out[k].error and out[k].npy is None for k in (2, 3, 4, 5))
