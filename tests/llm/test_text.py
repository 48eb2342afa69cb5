import hashlib
import math
import random
import re
import time

import numpy as np
import pytest
import zstandard
from cytofold.llm import language_id, license_scan, merkle, mixing, toxicity
from pyspark.sql import functions as F

# Merkle trees.

SPACE = " \t\n\x0b\f\r"
PARAGRAPH = rf"(?:[^{SPACE}.!?]{{1,24}}[{SPACE}]{{0,8}}){{1,16}}[.!?]{{0,8}}[{SPACE}]{{0,8}}|[.!?]{{1,8}}[{SPACE}]{{0,8}}|[{SPACE}]+"


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def tree(text):
    made = [[md5(p) for p in re.findall(PARAGRAPH, s)] for s in text.split("\n")]
    assert "\n".join("".join(re.findall(PARAGRAPH, s)) for s in text.split("\n")) == text
    return made


def print_of(text):
    t = tree(text)
    return "/".join([hashlib.sha256("".join(md5("".join(s)) for s in t).encode()).hexdigest(), *(md5("".join(s))[:16] + "".join(p[:8] for p in s) for s in t)])


def like(a, b):
    if a == b:
        return 1.0
    a, b = ({tuple(s) for s in tree(x)} for x in (a, b))
    same = sum(map(len, a & b))
    x, y = ({p for s in only for p in s} for only in (a - b, b - a))
    total = 2 * same + len(x) + len(y)
    return 2 * (same + len(x & y)) / total if total else 0.0


def report(docs):
    """What edit_report gives for (id, text): rows of one id by a hash of the text, so ids are unlike here."""
    order = sorted(docs, key=lambda x: (x[0] is None, -(x[0] or 0)))
    for (d, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        t, nxt = t or "", nxt or ""
        part = len(t) // 3
        edited = t[: len(t) - part] + nxt[:part]
        yield d, (len(t), hashlib.sha256(edited.encode()).hexdigest(), print_of(t), print_of(edited), pytest.approx(like(t, edited)), pytest.approx(like(t, nxt)))


def test_edit_report(spark):
    rng = random.Random(1)
    docs = [(i * 3 % 97, "".join(rng.choice("ab \n.é🙂") for _ in range(rng.randint(0, 80)))) for i in range(97)] + [(-5, None), (None, "no id"), (3000, "x" * 500), (3001, "one two! " * 4000)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: tuple(r)[1:-1] for r in merkle.edit_report(frame).collect()}
    assert got == dict(report(docs))


def test_edits_are_located(spark):
    rows = spark.createDataFrame([("A b c d. E f.\nsame line\nx", "A b c d. E Z.\nsame line\nx\nmore"), ("q", "q"), ("", "a")], "a string, b string")
    got = [[tuple(x) for x in r.e] for r in rows.select(merkle.edits(merkle.fingerprint(F.col("a")), merkle.fingerprint(F.col("b"))).alias("e")).collect()]
    assert got == [[(0, 1), (3, 0)], [], [(0, 0)]]


def test_an_id_that_most_rows_have(spark, monkeypatch):
    """Its rows are cut into slices; each text has one follower, and each but one is followed by its like."""
    monkeypatch.setattr(merkle, "REPEATED", 10)
    rows = [(7, f"text {i}") for i in range(60)] + [(7, "copy")] * 50 + [(None, "void")] * 40 + [(i, f"own {i}") for i in (1, 2, 8, 9)]
    found = merkle.with_next(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("at", F.lit("clash"))).collect()
    assert sorted((r.doc_id or -1, r.text) for r in found) == sorted((d or -1, t) for d, t in rows)
    assert sorted(r.next_text for r in found) == sorted(t for _, t in rows)
    assert sum(r.text == r.next_text == "copy" for r in found) == 49
    after = {r.text: r.next_text for r in found if r.text != r.next_text}
    assert (after["own 9"], after["own 2"], after["own 1"], after["void"]) == ("own 8", "own 1", "void", "own 9")
    chain, at = [], "own 8"
    while at != "own 2":
        at = after[at]
        chain.append(at)
    assert sorted(chain[:-1]) == sorted({t for d, t in rows if d == 7})


def test_one_and_no_document(spark):
    one = spark.createDataFrame([(1, "abc")], "doc_id bigint, text string")
    assert [(r.doc_id, r.text, r.next_text) for r in merkle.with_next(one).collect()] == [(1, "abc", "abc")]
    assert merkle.edit_report(one.limit(0)).count() == 0


# Mixing.


def brute_targets(sizes, weights=(5, 2, 1), cap=3.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, open_ = float(sum(sizes.values())), {}, set(names)
    while open_:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > cap * sizes[s] + 1e-9}
        if not over:
            return target | {s: weight[s] * level for s in open_}
        target |= {s: cap * sizes[s] for s in over}
        open_ -= over
    return target


def mixed(spark, seed, n=800):
    rng = random.Random(seed)
    rows = [(i, "w " * rng.randint(0, 60) if rng.random() < 0.98 else None, rng.choice(["é", "Z", "a", "b", None, "big", "big", "big", "tiny" if rng.random() < 0.1 else "a"])) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


@pytest.mark.parametrize("seed", range(2))
def test_mix(spark, seed):
    docs = mixed(spark, seed)
    rows = mixing.mix(docs).collect()
    again = sorted((r.doc_id, r.taken) for r in mixing.mix(docs.repartition(7)).collect())
    assert sorted((r.doc_id, r.taken) for r in rows) == again
    sizes: dict = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    want = brute_targets(sizes)
    assert len(rows) == 800
    for s, target in want.items():
        mine = [r for r in rows if r.source == s]
        assert mine[0].target == pytest.approx(target)
        assert mine[0].source_size == sizes[s]
        assert abs(sum(r.taken for r in mine) - target) <= 40
        copies = {r.copies for r in mine if r["size"]}
        assert max(copies) <= 3 and max(copies) - min(copies) <= 1
    taken = {(r.doc_id): r.copies for r in rows}
    out: dict = {}
    for r in mixing.mixture(docs).collect():
        out[r.doc_id] = out.get(r.doc_id, 0) + 1
    assert out == {d: c for d, c in taken.items() if c}


def test_inclusion_grows_with_size(spark):
    """Of documents of unlike size as many are taken as their inclusion probabilities say, and words meet the target."""
    rng = random.Random(4)
    rows = [(i, "w " * rng.choice([4, 8, 16, 64, 250]), "a") for i in range(6000)] + [(10_000 + i, "w " * 30, s) for i, s in enumerate("bbbcccc" * 800)]
    rows = [r for r in mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), weights=(1, 2, 4)).collect() if r.source == "a"]
    whole = int(rows[0].target // rows[0].source_size)
    assert sum(r.taken for r in rows) == pytest.approx(rows[0].target, rel=1e-3)
    assert sum(r.p * r["size"] + whole * r["size"] for r in rows) == pytest.approx(rows[0].target, rel=1e-3)
    seen = []
    for size in (4, 8, 16, 64, 250):
        mine = [r for r in rows if r["size"] == size]
        assert len({r.p for r in mine}) == 1
        seen.append(mine[0].p)
        assert sum(r.copies - whole for r in mine) / len(mine) == pytest.approx(mine[0].p, abs=0.04)
    assert seen == sorted(seen) and seen[0] < 0.1 < seen[-1]


def test_rows_that_repeat_are_taken_alike(spark):
    rows = [(i // 3, f"w {'x ' * (i // 3 % 11)}", "ab"[i // 3 % 2]) for i in range(300)] + [(None, None, None)] * 20 + [(None, "z z", None)] * 20
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("size", F.lit("clash")).withColumn("whole", F.lit("clash")).withColumn("limit", F.lit("clash"))
    plan: dict = {}
    for r in mixing.mix(docs).collect():
        plan.setdefault((r.doc_id, r.source, r["size"]), []).append(r.copies)
    assert all(len(set(c)) == 1 for c in plan.values())
    mixture = mixing.mixture(docs)
    assert mixture.columns == docs.columns
    assert mixture.count() == sum(map(sum, plan.values()))


def test_mix_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, None), (1, "a b", "s"), (1, "a b", "s"), (2, "", "t")], "doc_id bigint, text string, source string")
    assert sorted((r.doc_id, r["size"], r.taken) for r in mixing.mix(docs).collect()) == [(1, 0, 0), (1, 2, 2), (1, 2, 2), (2, 0, 0)]
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs.where("text is null or text = ''")).agg(F.sum("taken")).first()[0] == 0


# Languages.


def test_languages(spark):
    rng = random.Random(2)
    sound = {"xx": "ba da ga la mo no", "yy": "kri stu vlo zwa pfe", "zz": "aei oua iia eou"}
    say = lambda s: "".join(rng.choice(sound[s].split()) for _ in range(rng.randint(1, 4)))
    rows = [(i, " ".join(say(s) for _ in range(rng.randint(3, 80))), s) for i in range(300) for s in [rng.choice("xyz") * 2]]
    rows += [(1000, None, "xx"), (1001, "123 !?", "yy"), (1002, "", "zz"), (1003, "ba da", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    dictionaries = language_id.fit(docs, F.col("doc_id") % 4 != 2)
    got = {r.doc_id: r for r in language_id.identify(docs, dictionaries).collect()}
    held = [(i, lang) for i, t, lang in rows if i % 4 == 2 and i < 1000]
    assert sum(got[i].lang_pred == lang for i, lang in held) >= 0.95 * len(held)
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    assert all(0 <= r.score <= 1 for r in got.values())
    same = {"aa": dictionaries["xx"], "bb": dictionaries["xx"]}
    assert language_id.Sizer(same).predict("ba da ga") == ("aa", 0.0, True)
    assert language_id.identify(docs.limit(3), {}).select("lang_pred").distinct().first()[0] == "und"


def test_every_language_is_learned(spark):
    """Seventy languages; sizes by plain compression of whole texts."""
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéèñçøåπλδфжшщыэюя"
    sound = {f"l{k:02}": ["".join(rng.choice(letters) for _ in range(rng.randint(2, 4))) for _ in range(30)] for k in range(70)}
    say = lambda s, n: " ".join("".join(rng.choice(sound[s]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(None if i % 11 == 0 else 7, say(s, 60), s) for s in sound for i in range(6)]
    docs = spark.createDataFrame(rows + rows[:50], "doc_id bigint, text string, lang string")
    dictionaries = language_id.fit(docs, F.lit(True))
    assert sorted(dictionaries) == sorted(sound)
    asked = [(i, say(s, 40), s) for i, s in enumerate(sound)] + [(100, say("l05", 9000), "l05")]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(asked, "doc_id bigint, text string, lang string").drop("lang"), dictionaries).collect()}
    assert [got[i].lang_pred for i, _, _ in asked] == [s for _, _, s in asked]
    packers = {n: [zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False) for d in ds] for n, ds in dictionaries.items()}
    for i, t, _ in asked[:5] + asked[-1:]:
        data = t.lower().encode()
        data = data if len(t) > language_id.SHORT else b" ".join([data] * 4)
        sizes = sorted((sum(len(c.compress(data[k : k + language_id.BLOCK])) for c in cs for k in range(0, len(data), language_id.BLOCK)) / len(cs), n) for n, cs in packers.items())
        assert got[i].lang_pred == sizes[0][1]
        assert got[i].score == pytest.approx(1 - math.exp(-20 * (sizes[1][0] - sizes[0][0]) / sizes[0][0]), abs=0.05)


# Toxicity.


def test_terms_are_exchanged_within_their_kind_and_language():
    swap = toxicity.Swaps(toxicity.IDENTITY)
    assert swap({"les", "noirs", "sont"}) == {"les", "blancs", "sont"}
    assert swap({"hindus", "christen"}) == {"buddhisten", "muslime"}
    assert swap({"hindus", "jews"}) == {"buddhists", "hindus"}
    assert swap({"nobody"}) is None


def test_the_fit_is_the_least_loss():
    """Scores by plain sums; the weights are where the loss, worked out plainly, is flat."""
    rows = sentences(random.Random(7), 150)
    texts, labels = [t for t, _ in rows], [y for _, y in rows]
    model = toxicity.train(texts, labels, steps=4000)
    of = lambda text: {f for w in text.split() for f in ["=" + w, *(f"<{w}>"[i : i + n] for n in (4, 5) for i in range(len(w) + 3 - n))]}
    raw = lambda w, b, text: b + sum(w.get(f, 0.0) for f in of(text))
    kept: dict = {}
    for t in texts[:40]:
        assert model.score(t, kept) == pytest.approx(1 / (1 + math.exp(-raw(model.weights, model.intercept, t))))

    def loss(w, b):
        n1, total = sum(labels), 0.0
        for t, y in zip(texts, labels, strict=True):
            x = raw(w, b, t)
            total += 0.5 / (n1 if y else len(labels) - n1) * (math.log1p(math.exp(-x)) if y else math.log1p(math.exp(x)))
            if "muslims" in t.split():
                total += toxicity.SWAP / len(labels) * (x - raw(w, b, t.replace("muslims", "jews"))) ** 2
        return total + 0.5 * toxicity.RIDGE * sum(v * v for v in w.values())

    least = loss(model.weights, model.intercept)
    for f in random.Random(1).sample(sorted(model.weights), 12):
        for by in (-0.05, 0.05):
            assert loss(model.weights | {f: model.weights[f] + by}, model.intercept) > least
    assert loss(model.weights, model.intercept + 0.05) > least < loss(model.weights, model.intercept - 0.05)


def sentences(rng, n):
    """Insults make texts toxic; one group's name stands in most toxic texts and few others."""
    plain = [f"w{i}x" for i in range(200)]
    plain = ["".join(chr(97 + int(c)) for c in w[1:-1]) + "o" for w in plain]
    out = []
    for _ in range(n):
        bad = rng.random() < 0.3
        w = rng.sample(plain, 12) + (rng.sample(["vilescum", "dumbfool", "trashbag"], 1) if bad else [])
        if rng.random() < (0.8 if bad else 0.05):
            w.append("muslims")
        rng.shuffle(w)
        out.append((" ".join(w), int(bad)))
    return out


def test_swapped_names_change_little():
    rows = sentences(random.Random(1), 600)
    texts, labels = [t for t, _ in rows], [y for _, y in rows]
    fair, unfair = toxicity.train(texts, labels), toxicity.train(texts, labels, swap=0.0)
    raw = lambda m, text: m.of_words(set(text.split()), {})
    change = lambda m: abs(raw(m, "the muslims next door") - raw(m, "the women next door"))
    assert change(unfair) > 1.5
    assert change(fair) < 0.2
    test = sentences(random.Random(2), 300)
    kept: dict = {}
    assert np.mean([(fair.score(t, kept) >= 0.5) == bool(y) for t, y in test]) > 0.95


def test_scores_of_rows(spark):
    rows = sentences(random.Random(3), 200)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)] + [(900, None), (901, ""), (None, "dumbfool")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)] + [(0, 1), (None, 1), (3, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 203 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    none = toxicity.fit(docs, labels.limit(0))
    assert {r.predicted for r in toxicity.score(docs, none).collect()} == {0}


# Licenses.


def brute_scan(text, templates, threshold):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    matches = set()
    for label, texts in templates.items():
        for t in texts:
            s, step = set(re.findall(r"[a-z0-9]+", t)), 32
            while step < len(re.findall(r"[a-z0-9]+", t)):
                step *= 2
            for start in range(0, max(1, len(words)), step):
                block = set(words[start : start + 2 * step])
                if len(s & block) >= threshold * len(s) - 1e-9:
                    matches.add((start, 2 * step, label, len(s & block) / len(s)))
    return words, places, labels, matches


def test_scans(spark):
    rng = random.Random(6)
    pool = [w for ts in license_scan.TEMPLATES.values() for t in ts for w in t.split()] + ["Foo", "bär", "x1", "MIT", "License", "CC-BY", "apache"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 200))) for _ in range(60)]
    for ts in license_scan.TEMPLATES.values():
        for t in ts:
            w = t.split()
            if len(w) > 8:
                w[3] = "changed"
            texts.append(" ".join(["filler"] * rng.randint(0, 90) + w + ["tail"] * rng.randint(0, 90)))
    texts += [None, "", "GNU General Public License. The GNU general public license", "cc by cc by", "mit license license"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in license_scan.scan_documents(docs).collect()}
    scanner = license_scan.Scanner(license_scan.frequencies(docs))
    for i, t in enumerate(texts):
        words, places, base, matches = brute_scan(t, license_scan.TEMPLATES, license_scan.THRESHOLD)
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted(base))
        assert r.labels == ",".join(sorted(base | {m[2] for m in matches}))
        assert set(scanner.matches(license_scan.words(t))) == matches


GRANT = "it under the terms of the GNU {}General Public License as published by the Free Software Foundation; either version {} of the License, or later"
NEAR_MISSES = [
    ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
    ("This work is licensed under the GNU General Public License, version 2.", "gpl,gpl-2.0"),
    ("You can redistribute " + GRANT.format("", 2), "gpl,gpl-2.0"),
    ("You can redistribute " + GRANT.format("", 3), "gpl,gpl-3.0"),
    ("You can redistribute " + GRANT.format("Lesser ", 3), "lgpl"),
    ("You can redistribute " + GRANT.format("Affero ", 3), ""),
    ("Licensed under CC BY 4.0", "cc-by,cc-by-4.0"),
    ("Licensed under CC BY-NC 4.0", "cc-by,cc-by-nc-4.0"),
    ("Licensed under CC BY-SA 4.0", "cc-by,cc-by-sa-4.0"),
    ("Licensed under CC BY-NC-SA 4.0", "cc-by"),
    ("Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa-4.0"),
    ("Licensed under the Mozilla Public License, version 2.0", "mpl-2.0"),
    ("Licensed under the Apache License, Version 2.0", "apache,apache-2.0"),
    ("Released under the BSD license", ""),
    ("Released under the MIT license", "mit"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. The software is provided as is", ""),
    ("under the Educational License; you may not use this file except in compliance with the License. You may obtain a copy of the License at", ""),
]


def test_a_whole_license():
    """A template of over 150 words is found wherever it stands, edited here and there, and isn't found in its half."""
    count = {w: 0 for _, s, _ in license_scan.template_sets() for w in s}
    scanner = license_scan.Scanner(count)
    whole = license_scan.TEMPLATES["mit"][-1].split()
    for lead in (0, 100, 255, 700):
        parts = license_scan.words(" ".join(["filler"] * lead + [w if i % 20 else "edited" for i, w in enumerate(whole)] + ["tail"] * 300))
        assert max((m for m in scanner.matches(parts) if m[1] == 512), key=lambda m: m[3])[2] == "mit"
    assert not [m for m in scanner.matches(license_scan.words(" ".join(whole[: len(whole) // 2]))) if m[1] == 512]


def test_very_many_places():
    scanner = license_scan.Scanner({w: 0 for _, s, _ in license_scan.template_sets() for w in s})
    began = time.time()
    assert scanner.scan("mit license " * 100_000)[:5] == (200_000, 100_000, 0, 199_998, "mit")
    assert time.time() - began < 10


def test_labels_of_near_misses():
    count = {w: 0 for _, s, _ in license_scan.template_sets() for w in s}
    scanner = license_scan.Scanner(count, telling=license_scan.TELLING)
    for lead in (0, 20, 50):
        got = [scanner.scan("filler " * lead + text + " tail" * 40)[5] for text, _ in NEAR_MISSES]
        assert got == [labels for _, labels in NEAR_MISSES]
