import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedmill.llm import langid, licenses, quality, toxicity, training

DATA = "/root/testdata/sf0.01"


def brute_segments(scores):
    out = []

    def search(a, b):
        best = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > 1e-9 and (best is None or total > best[2] + 1e-9):
                    best = (i, j, total)
        if best:
            out.append(best)
            search(a, best[0])
            search(best[1] + 1, b)

    search(0, len(scores))
    return sorted((a, b, round(t, 6)) for a, b, t in out)


def test_segments_match_brute_force():
    rng = random.Random(3)
    for _ in range(80):
        scores = [rng.random() * 1.1 + 0.01 if rng.random() < 0.35 else -rng.random() * 0.8 - 0.01 for _ in range(rng.randint(1, 30))]
        assert sorted((a, b, round(t, 6)) for a, b, t in toxicity.segments(scores)) == brute_segments(scores)


def test_decay_solves_its_equation():
    scores, share = np.array([2.0, 4.0]), np.array([0.01, 0.002])
    x = toxicity._decay(scores, share)
    assert abs((share * np.exp(x * scores)).sum() + (1 - share.sum()) * math.exp(-x * toxicity.DRIFT) - 1) < 1e-6


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


def test_toxicity_on_held_out_rows(spark, tables):
    docs, labels = tables
    out = toxicity.toxicity(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = out[out.held_out]
    assert len(held) > 40 and ((held.predicted == held.toxic).mean()) > 0.9
    assert held[held.predicted == 1].toxic.mean() > 0.9
    assert out.score.between(0, 1).all()


def edge_rows():
    return [(1, None, 3, "a"), (2, "", 0, "b"), (None, "The idiot the", 1, "c"), (3, "x" * 300_000, 1, "d"), (4, "word " * 50_000, 1, "e"), (4, "word " * 50_000, 1, "e"), (5, "123 !!", None, "f")]


def test_edge_rows_keep_their_number(spark, tables):
    docs, labels = tables
    schema = "doc_id long, text string, n_chars long, score string"
    odd, none = spark.createDataFrame(edge_rows(), schema), spark.createDataFrame([], schema)
    no_labels = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    field = langid.fit(docs, rows=40)
    for made in (lambda d: toxicity.toxicity(d, no_labels), lambda d: quality.quality(d, no_labels), lambda d: langid.identified(d, field), lambda d: langid.language_id(d.withColumn("lang", langid.F.lit(None).cast("string"))), licenses.scan):
        assert made(odd).count() == len(edge_rows())
        assert made(none).count() == 0
    got = {(r.doc_id, r.lang_pred, r.score) for r in langid.identified(odd, field).collect() if r.doc_id in (1, 2, 5)}
    assert got == {(1, "und", 0.0), (2, "und", 0.0), (5, "und", 0.0)}
    assert {r.lang_pred for r in langid.language_id(odd.withColumn("lang", langid.F.lit(None).cast("string"))).collect()} == {"und"}
    assert {r.score for r in toxicity.toxicity(odd, no_labels).collect()} == {toxicity.Model({}, weights=(math.log(1e-9), 0.0)).score([])}


def test_quality_on_held_out_rows(spark, tables):
    docs, labels = tables
    out = quality.quality(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = out[out.held_out]
    assert (held.predicted == held.quality).mean() > 0.8
    assert held[held.quality == 1].predicted.mean() > 0.9


def test_factorisation_machine_identity():
    rng = np.random.default_rng(1)
    m = quality.Machine(0.3, rng.normal(size=quality.WIDTH), rng.normal(size=(quality.WIDTH, quality.RANK)))
    index, value = quality.features("Some words, some Words! And 12 lines\nof text", 44)
    pairs = sum((m.vectors[i] @ m.vectors[j]) * a * b for (i, a), (j, b) in itertools.combinations(zip(index, value, strict=True), 2))
    assert m.raw(index, value) == pytest.approx(0.3 + m.weights[index] @ value + pairs)


def test_marginals_match_enumeration():
    rng = np.random.default_rng(2)
    scores, moves = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3))
    lengths = np.array([4, 2])
    each, pairs, _ = langid.marginals(scores, moves, lengths)
    want_pairs = np.zeros((3, 3))
    for row, n in enumerate(lengths):
        weights, total = np.zeros((n, 3)), 0.0
        joint = np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            w = math.exp(sum(scores[row, t, k] for t, k in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
            total += w
            for t, k in enumerate(path):
                weights[t, k] += w
            for a, b in itertools.pairwise(path):
                joint[a, b] += w
        assert np.allclose(each[row, :n], weights / total)
        want_pairs += joint / total
    assert np.allclose(pairs, want_pairs)


def test_language_on_held_out_rows_and_in_mixed_text(spark, tables):
    docs, _ = tables
    field = langid.fit(docs)
    out = langid.language_id(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id").dropna()
    held = out[out.held_out]
    assert len(held) > 100 and (held.lang_pred == held.lang).mean() > 0.98
    texts = {r.lang: r.text for r in docs.where("n_chars between 400 and 900 and doc_id < 400").collect()}
    one, two = langid.words_of(texts["en"])[:40], langid.words_of(texts["de"])[:40]
    labels = field.label([one + two])[0].argmax(axis=1)
    assert (labels[:38] == field.names.index("en")).mean() > 0.9 and (labels[42:] == field.names.index("de")).mean() > 0.9


def test_very_long_texts_in_pieces_match_whole_ones(spark, tables, monkeypatch):
    docs, _ = tables
    field = langid.fit(docs)
    texts = [r.text for r in docs.where("text is not null and n_chars > 200").orderBy("doc_id").limit(30).collect()] + ["", None]
    whole = field.document(texts)
    monkeypatch.setattr(langid, "LONG", 150)
    monkeypatch.setattr(langid, "PIECE", 7)
    pieces = field.document(texts)
    assert [a for a, _ in whole] == [a for a, _ in pieces] and np.allclose([b for _, b in whole], [b for _, b in pieces], atol=1e-5)


def test_every_language_is_learned(spark):
    rows = [(i, f"{chr(0x4E00 + i % 70)}{chr(0x4E00 + i % 70)} word", f"l{i % 70}") for i in range(700)]
    field = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(field.names) == 70


def brute_base(text):
    words, found, word = [], [], ""
    for c in text or "":
        c = c.lower() if "A" <= c <= "Z" else c
        if c.isascii() and not (c.isdigit() or "a" <= c <= "z"):
            words.append(word)
            word = ""
        else:
            word += c
    words = [w for w in [*words, word] if w]
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), sorted(found)


def test_base_places_match_brute_force():
    scanner = licenses.Scanner()
    rng = random.Random(5)
    pieces = ["GNU", "general", "Public", "license", "MIT", "cc", "by", "CC-BY", "apache", ".", "\n", "é", "licence", "v2", "cc by", "mit license"]
    for _ in range(300):
        text = " ".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))
        n, base, _ = scanner.scan(text)
        assert (n, sorted(base)) == brute_base(text)


def test_template_regions():
    scanner = licenses.Scanner({"t": "alpha [[beta]] gamma {{1 2 [0-9]+}} delta", "u": "{{1 2}} is free [[[as in]] speech]]".replace("[[[", "[[ [[").replace("]] speech", "]] speech")})
    labels = lambda s: {label for *_, label in scanner.scan(s)[2]}
    assert labels("x ALPHA beta, gamma 1 2 delta y") == {"t"} and labels("alpha gamma 7 delta") == {"t"}
    assert labels("alpha beta beta gamma 7 delta") == set() and labels("alpha gamma x delta") == set() and labels("alpha gamma 1 2 3 delta") == set() and labels("alpha gamma delta") == set()
    assert labels("This tool is free") == {"u"} and labels("is free") == set()
    with pytest.raises(ValueError):
        licenses.Automaton("a [[ b")


def test_public_notices_are_found():
    scanner = licenses.Scanner()
    for text, label in (("Released under the MIT License.", "mit-notice"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), ("Licensed under the Apache License, Version 2.0.", "apache-2.0-notice"), ("This work is licensed under the GNU General Public License, version 3.", "gpl-notice")):
        assert label in {x for *_, x in scanner.scan("Before. " + text + " After")[2]}, text
    assert "mit-notice" not in {x for *_, x in scanner.scan("Released under an MIT License.")[2]}


def as_regex(template):
    """A template as one regular expression over words that each end in a space."""
    out = []
    for found in licenses._MARK.finditer(template):
        part = found[0]
        if part == "[[":
            out.append("(?:")
        elif part == "]]":
            out.append(")?")
        elif part.startswith("{{"):
            out.append(f"(?:(?:{found[3] or '[^ ]+'}) ){{{found[1]},{found[2]}}}")
        else:
            out += [re.escape(w) + " " for w in licenses.words_of(part)]
    return re.compile("".join(out))


def brute_matches(text, label, template):
    words, pattern, out = licenses.words_of(text), as_regex(template), {}
    for start in range(len(words)):
        ends = [end for end in range(start + 1, len(words) + 1) if pattern.fullmatch("".join(w + " " for w in words[start:end]))]
        if ends:
            out[max(ends)] = min(start, out.get(max(ends), start))
    return {(start, end, label) for end, start in out.items()}


def test_templates_match_brute_force():
    rng = random.Random(8)
    small = {"a": "alpha [[beta [[and]]]] gamma {{1 2 [0-9]+}} delta", "b": "{{0 2}} is free [[of]] {{1 3}} charge", "c": "gamma [[{{1 1}}]] gamma"}
    scanner = licenses.Scanner(small)
    pieces = ["alpha", "beta", "and", "gamma", "7", "12", "delta", "is", "free", "of", "charge", "x"]
    for _ in range(400):
        text = " ".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        want = set().union(*(brute_matches(text, k, t) for k, t in small.items()))
        assert set(scanner.scan(text)[2]) == want, text


def filled(template, rng):
    out, keep = [], [True]
    for found in licenses._MARK.finditer(template):
        part = found[0]
        if part == "[[":
            keep.append(keep[-1] and rng.random() < 0.5)
        elif part == "]]":
            keep.pop()
        elif keep[-1]:
            out += ["2024"[: 1 if "{4}" not in part else 4]] * rng.randint(int(found[1]), int(found[2])) if part.startswith("{{") else licenses.words_of(part)
    return out


def test_whole_licenses_are_accepted_and_changed_ones_are_not():
    scanner, rng = licenses.Scanner(), random.Random(4)
    for label in ("mit-text", "bsd-2-clause", "bsd-3-clause", "isc", "zlib", "unlicense", "gpl-header", "agpl-header", "lgpl-header", "apache-header", "mpl-2.0-header"):
        for _ in range(5):
            words = filled(licenses.TEMPLATES[label], rng)
            assert label in {x for *_, x in scanner.scan("before " + " ".join(words) + " after")[2]}, label
            at = rng.randrange(len(words) // 3, len(words) - 10)
            changed = [*words[:at], "only", "noncommercially", *words[at:]]
            found = label in {x for *_, x in scanner.scan(" ".join(changed))[2]}
            assert found == bool(brute_matches(" ".join(changed), label, licenses.TEMPLATES[label])), (label, at)


def test_scan_rows(spark):
    out = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([(1, "cc by x mit license cc by", 3), (2, None, 4)], "doc_id long, text string, labels int")).collect()}
    assert (out[1].n_words, out[1].n_base, out[1].first_word, out[1].last_word, out[1].base_labels, out[1].labels, out[1].score) == (7, 3, 0, 5, "cc-by,mit", "cc-by,mit", 0.5)
    assert (out[2].n_words, out[2].n_base, out[2].first_word, out[2].last_word, out[2].base_labels, out[2].labels, out[2].score) == (0, 0, None, None, "", "", 0.0)


def test_signs_of_numbers_are_no_letters(spark):
    assert langid.words_of("½ ² Ⅷ 一二 x²y ßÉ_a1b") == ["一二", "x", "y", "ßé", "a", "b"]
    assert list(langid.words_in("a²b c")) == langid.words_of("a²b c")
    docs = spark.createDataFrame([(i, f"the word of number {i}", "en") for i in range(40)] + [(100, "½ ² Ⅷ", "en"), (101, "١٢٣ ①", None)], "doc_id long, text string, lang string")
    out = {r.doc_id: (r.lang_pred, r.score) for r in langid.language_id(docs).collect()}
    assert out[100] == out[101] == ("und", 0.0) and out[0][0] == "en"


def test_fits_hold_a_bounded_number_of_characters(spark):
    texts = [(i, "word " * 10, i % 2) for i in range(200)] + [(1000, "long " * 60_000, 0), (1001, "long " * 60_000, 1)]
    docs = spark.createDataFrame([(i, t, str(k)) for i, t, k in texts], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, k) for i, _, k in texts], "doc_id long, quality int")
    for sample in (training.labelled_sample(docs, labels, "quality", 4, 2, 1000, 2_000), training.sample_by_class(docs, "lang", 4, 2, 300, 1000, 2_000)):
        rows = sample.collect()
        assert 2_000 <= sum(len(r.text) for r in rows) <= 2_200 and {int(r.label) for r in rows} == {0, 1}
    only_long = docs.where("doc_id >= 1000").withColumn("doc_id", F.col("doc_id") * 7)
    assert training.sample_by_class(only_long, "lang", 4, 2, 300, 1000, 10).count() >= 1


def test_held_out_rows_teach_nothing(spark, tables):
    """op3, op9 and op10: with the labels of held-out rows turned round, every score stays the same."""
    docs, labels = tables
    fold = lambda folds, out: F.crc32(F.col("doc_id").cast("string")) % folds == out
    turned = labels.withColumn("toxic", F.when(fold(5, 0), 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.when(fold(4, 2), 1 - F.col("quality")).otherwise(F.col("quality")))
    renamed = docs.withColumn("lang", F.when(fold(4, 2), F.lit("xx")).otherwise(F.col("lang")))
    rows = lambda frame: sorted((tuple(r) for r in frame.collect()), key=repr)
    assert rows(toxicity.toxicity(docs, labels)) == rows(toxicity.toxicity(docs, turned))
    assert rows(quality.quality(docs, labels)) == rows(quality.quality(docs, turned))
    assert rows(langid.language_id(docs)) == rows(langid.language_id(renamed))
