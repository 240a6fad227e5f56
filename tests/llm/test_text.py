"""Classifiers, licences, edit matching and pages."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import blocks, edits, licences, ordinal, toxicity, warc

FOLDER = "/root/testdata/sf0.01"


def test_ordinal_recovers_four_grades():
    dice = random.Random(1)
    texts, grades = [], []
    for _ in range(600):
        g = dice.randrange(4)
        # the worse the grade, the more junk and repetition
        words = ["the good word of text".split()[dice.randrange(5)] + ("###" if dice.random() < 0.3 * (3 - g) else "") for _ in range(60)]
        texts.append(" ".join(words))
        grades.append(g)
    model = ordinal.fit([ordinal.features(t) for t in texts[:400]], np.array(grades[:400]))
    assert (np.diff(model.cuts) > 0).all()
    p = model.probabilities([model.score(t) for t in texts[400:]])
    assert np.allclose(p.sum(1), 1)
    assert np.abs(p @ model.grades - np.array(grades[400:])).mean() < 0.5


def test_ordinal_rows(spark, documents):
    ratings = spark.createDataFrame([(1, 1, "x"), (4, 0, "y"), (3, 0, None), (None, 1, None), (5, None, None), (1, 1, "z")], "doc_id long, quality int, text string")
    model = ordinal.train(documents, ratings)
    rows = ordinal.score(documents, model).collect()
    assert len(rows) == documents.count() and all(0 <= r.tail <= 1 for r in rows)
    assert ordinal.select(documents, model).columns == documents.columns
    nothing = ordinal.train(documents, ratings.limit(0))
    assert all(r.keep for r in ordinal.score(documents, nothing).collect())
    assert ordinal.score(documents.limit(0), model).count() == 0


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_held_out_accuracy(spark, kind):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    if kind == "quality":
        train = labels.where(~toxicity.held_out())
        scored = ordinal.score(docs, ordinal.train(docs, train)).select("doc_id", F.col("keep").cast("int").alias("said"))
    else:
        scored = toxicity.score(docs, toxicity.train(docs, labels)).select("doc_id", F.col("predicted").alias("said"))
    test = labels.where(toxicity.held_out()).join(scored, "doc_id").select(F.col(kind).alias("true"), "said").toPandas()
    assert (test.true == test.said).mean() > (0.97 if kind == "quality" else 0.9)


def test_label_model_weighs_voters():
    dice = np.random.default_rng(2)
    truth = dice.random(2000) < 0.2
    good = (dice.random((2000, 3)) < np.where(truth[:, None], 0.7, 0.02)).astype(float)
    poor = (dice.random((2000, 1)) < np.where(truth[:, None], 0.35, 0.15)).astype(float)
    votes = np.hstack([good, poor, poor, poor])  # one poor voter three times over
    model = toxicity.label_model(votes, 0.2)
    assert model.toxic[:3].min() > 0.5 and model.clean[:3].max() < 0.1
    assert (model.stands_for[3:] > model.stands_for[:3].max()).all()
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.95


def test_toxicity_rows(spark, documents):
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(documents, labels)
    rows = toxicity.score(documents, model).collect()
    assert len(rows) == documents.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert toxicity.without_toxic(documents, model).columns == documents.columns
    assert toxicity.score(documents.limit(0), toxicity.train(documents.limit(0), labels.limit(0))).count() == 0


def distance(item, text):
    previous = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(previous[j] + 1, now[-1] + 1, previous[j - 1] + (a != b)))
        previous = now
    return min(previous)


def test_edit_matches_equal_brute_force():
    dice = random.Random(5)
    syllables = "the ren tion ande a or ing heea lst of".split()
    sentence = lambda n: " ".join("".join(dice.choice(syllables) for _ in range(dice.randint(1, 3))) for _ in range(n))
    items = [(i, sentence(dice.randint(1, 30))) for i in range(20)]
    finder = edits.Finder(items, 0.1)
    found = 0
    for _ in range(60):
        _, text = dice.choice(items)
        changed = list(text)
        for _ in range(dice.randint(0, len(text) // 8 + 1)):
            i = dice.randrange(len(changed) + 1)
            changed[i : i + dice.randint(0, 1)] = dice.choice(["", "x", "y "])
        text = edits.normal(sentence(10) + " " + "".join(changed) + "  " + sentence(10))
        want = {(i, d) for i, item in items if (d := distance(item, text)) <= int(0.1 * len(item))}
        assert {(i, d) for i, d, _ in finder.hits(text)} == want
        found += len(want)
    assert found > 30


def test_edit_rows(spark, documents):
    items = spark.createDataFrame([(1, "The CAT sat  on the mat"), (2, None), (3, " "), (None, "cat"), (4, "the cat sat on the mat"), (5, "bat " * 60)], "item_id long, text string")
    rows = edits.matches(documents, items).collect()
    assert sorted((r.doc_id, r.item_id, r.distance) for r in rows) == [(1, 1, 0)] * 2 + [(1, 4, 0)] * 2
    left = edits.without_leaks(documents, items)
    assert left.columns == documents.columns and left.count() == documents.count() - 2
    assert edits.matches(documents, items.limit(0)).count() == 0 and edits.matches(documents.limit(0), items).count() == 0
    # items in several blocks give the same rows
    assert edits.item_blocks(items, block_chars=40)[1] > 1
    assert sorted(map(tuple, edits.matches(documents, items, block_chars=40).collect())) == sorted(map(tuple, rows))
    assert edits.without_leaks(documents, items, block_chars=40).count() == left.count()


def scan_brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in licences.BASE.items():
        parts = phrase.split()
        at = [i for i in range(len(words) - len(parts) + 1) if words[i : i + len(parts)] == parts]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licences(spark):
    texts = [
        None,
        "",
        "CC BY cc by-cc.by CC\tBY",
        "All rights reserved. all rights all rights reserved",
        "Released under the MIT License.",
        "Licensed under the Apache License, Version 2.0.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under CC BY-NC 4.0.",
        "the license of MIT is mit",
        "word " * 3000 + "Licensed under the Apache License, Version 2.0, and released under the MIT License",
        "Ünder cc_by ccby xcc by",
        "cc",
    ] + ["plain words of a text that has no such statement"] * 60
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, words string, score string")
    rows = {r.doc_id: r for r in licences.scan(docs).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == scan_brute(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert [rows[i].labels for i in (4, 5, 6, 7, 8, 9, 12)] == ["mit", "apache-2.0", "gpl,gpl-3.0", "cc-by,cc-by-nc", "", "apache-2.0,mit", ""]
    assert licences.scan(docs.limit(0)).count() == 0


NOTICES = [
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "Licensed under the Apache License, Version 2.0.",
    "Released under the MIT License.",
    "Licensed under the GNU General Public License, version 3.",
    "Subject to the terms of the Mozilla Public License, v. 2.0.",
]


def test_licences_of_many_notices(spark):
    texts = [" ".join(NOTICES), "a person may copy the source of free software subject to terms " * 500 + NOTICES[2], *["plain words"] * 60]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in licences.scan(docs).collect()}
    assert [rows[i].labels for i in range(3)] == ["apache-2.0,bsd,gpl,gpl-3.0,mit,mpl-2.0", "apache-2.0", ""]


def test_licences_of_frequent_notices(spark):
    def labels(texts):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        return [r.labels for r in licences.scan(docs).orderBy("doc_id").collect()]

    plain = ["plain words"] * 40
    assert labels(NOTICES * 2) == ["mit", "bsd", "apache-2.0", "mit", "gpl,gpl-3.0", "mpl-2.0"] * 2
    # a group that holds a third of all rows, and a shorter statement beside it
    assert labels([f"Text {i}. {NOTICES[3]}" for i in range(20)] + ["Under the MIT License"] + plain) == ["mit"] * 21 + [""] * 40
    assert labels(["Under the MIT License"] * 20 + plain) == ["mit"] * 20 + [""] * 40


def labels_brute(texts):
    """The labels and scores by plain loops over all places."""
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) for t in texts]
    df = {w: sum(w in set(x) for x in words) for w in licences.VOCABULARY}
    weight = {w: math.log(1 + len(texts) / (df[w] + 1)) for w in df}
    out = []
    for x, text in zip(words, texts, strict=True):
        labels, best = set(filter(None, scan_brute(text)[4].split(","))), 0.0
        best = 1.0 if labels else 0.0
        for label, wording, key in licences.TEMPLATES:
            template, keys = wording.split(), key.split()
            at, rarest = licences.looked_up(wording, weight)
            begin = next(i for i in range(len(template)) if template[i : i + len(keys)] == keys)
            for s in range(-len(template), len(x)):
                stands = {w for w in at if 0 <= s + at[w] < len(x) and x[s + at[w]] == w}
                if s + begin >= 0 and x[s + begin : s + begin + len(keys)] == keys and len(stands & set(rarest)) >= min(2, len(rarest)):
                    score = sum(weight[w] for w in stands) / sum(weight[w] for w in at)
                    best = max(best, score)
                    if score >= licences.LEAST_SCORE:
                        labels.add(label)
        out.append((",".join(sorted(labels)), round(min(1.0, best), 9)))
    return out


def scanned(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.labels, round(r.score, 9)) for r in licences.scan(docs).orderBy("doc_id").collect()]


REAL = [
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; version 2.1",
    "// SPDX-License-Identifier: MIT",
    "# SPDX-License-Identifier: Apache-2.0",
    "MIT License\n\nCopyright (c) nobody",
    "License: Apache-2.0",
]


def test_licence_labels_equal_plain_loops(spark):
    dice = random.Random(8)
    pool = [*NOTICES, *REAL, "released into the public domain", "the license of MIT", "version 3", "a person may copy", "Licensed under CC BY-SA 4.0", "plain words " * 5]
    texts = [None, "", *REAL]
    for _ in range(120):
        words = " ".join(dice.choices(pool, k=dice.randint(1, 4))).split()
        for _ in range(dice.randint(0, 4)):
            words[dice.randrange(len(words))] = dice.choice(["x", "license", "gnu", "mit"])
        texts.append(" ".join(words))
    assert scanned(spark, texts) == labels_brute(texts)
    assert [x for x, _ in scanned(spark, REAL + ["plain"] * 20)][:6] == ["gpl,gpl-3.0", "gpl,lgpl", "mit", "apache-2.0", "mit", "apache-2.0"]


def test_frequencies_decide_candidates_and_score(spark):
    # a notice without three of its words: in a corpus where those are rare they cost more than the threshold allows
    torn = "permission is hereby granted free of charge to any x x a x of this x"
    missing = "person obtaining copy software"
    common = "permission hereby granted free charge"
    rare = scanned(spark, [torn] + [common] * 40 + ["plain"] * 40)[0]
    frequent = scanned(spark, [torn] + [missing] * 40 + ["plain"] * 40)[0]
    assert rare[0] == "" and frequent[0] == "mit" and rare[1] < licences.LEAST_SCORE <= frequent[1]


PAGE = """<html><head><title>No</title></head><body><header class="site-header"><a href=/>Home</a></header>
<nav><ul><li><a href=x>one</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
{open}<h1>A title</h1><p>It is a text about the &amp; and what was in it, as it should be for all of us who
read it with care, and it goes on for long enough that the rules can tell it from what stands beside the text.</p><script>var t = "<p>no</p>";</script>
<p>Short <b>one</b>.</p><p>The rest of the text is here and it is as long as the one above, so that the short block
between them has good neighbours on both of its sides, which is what the second of the two passes looks for.</p>{close}
<aside>Related: <a href=y>other</a></aside><div id="comments"><p>It was the best of texts and I have read it all, as one of the first who did so, with all of my time.</p></div>
<form><label>Your mail</label></form><footer>&copy; nobody</footer><!-- the end --><foot"""
TEXT = (
    "A title It is a text about the & and what was in it, as it should be for all of us who read it with care, and it goes on for long enough that the rules can tell it from what stands beside the text. "
    "Short one. The rest of the text is here and it is as long as the one above, so that the short block between them has good neighbours on both of its sides, which is what the second of the two passes looks for."
)


@pytest.mark.parametrize("around", [("<article>", "</article>"), ("<div>", "</div>"), ('<div role="main">', "</div>")])
def test_main_text(around):
    assert blocks.main_text(PAGE.format(open=around[0], close=around[1])) == TEXT


LONG = "It is a text about the things that were in it, as it should be for all of us who read it with care, and it goes on for long enough that the rules can tell."


@pytest.mark.parametrize("name", ["article", "main"])
def test_rules_decide_beside_and_inside_marked_text(name):
    # the text in a plain container, a teaser in the marked one
    assert blocks.main_text(f"<body><div><p>{LONG}</p><p>{LONG}</p></div><{name}><p>Read more of it</p></{name}></body>").startswith(f"{LONG} {LONG}")
    # an unmarked list of links in the marked container
    links = "".join(f"<li><a href=/{i}>Some other page {i}</a></li>" for i in range(5))
    assert blocks.main_text(f"<{name}><h1>Title</h1><p>{LONG}</p><p>x = 1</p><h3>More</h3><ul>{links}</ul></{name}>") == f"Title {LONG} x = 1"
    # words of other languages and short lines of the text stay
    assert blocks.main_text(f"<nav>a</nav><{name}><h1><a href=/>Title</a></h1><p>Krótki</p><p>{'słowa tekstu ' * 12}</p></{name}><footer>b</footer>") == f"Title Krótki {'słowa tekstu ' * 12}".strip()


@pytest.mark.parametrize(
    ("before", "after"),
    [
        ("<html><head><title>t</title><meta charset=utf-8><script>var t = '<p>'</script><body>", ""),
        ("<html><head><title>t</title>", ""),
        ("<body class='no-sidebar'>", ""),
        ("<body style='display:none'><main>", "</main>"),
        ("<div id='content' class='with-sidebar'>", "</div>"),
        ("<div class='has-header'><article>", "</article></div>"),
        ("<div class='share-enabled'><div class='post-tags'>", "</div></div>"),
        ("<form action=/ ><div><main>", "</main></div></form>"),
        ("<article class='post has-comments'>", "</article>"),
        ("<div class='widget'><div class='header'>", "</div></div>"),
        ("<div class=ad>Longer than all of it. " + LONG * 4 + "</div><article>", "</article>"),
        ("<header-bar>x</header-bar><style-guide>", "</style-guide>"),
    ],
)
def test_names_of_wrappers_empty_no_page(before, after):
    side = "<div class='sidebar'><p>It is beside the text and not a part of it, as all of us can see.</p></div>"
    assert blocks.main_text(f"{before}<p>{LONG}</p><p>{LONG}</p>{after}{side}<form><p>Your mail to us</p></form>") == f"{LONG} {LONG}"


MORE = "Of the rest there is as much as of the text itself, and it is not for us to say which of the two was the better one, as all of it was here before we had come to it and will be here after. "


@pytest.mark.parametrize("name", ["comments", "post-comments", "comment-list", "advert", "sponsored box", "cookie_notice", "sidebarLeft"])
@pytest.mark.parametrize(("before", "after"), [("<article>", "</article>"), ("<div>", "</div>")])
def test_beside_the_text_however_long(name, before, after):
    assert blocks.main_text(f"{before}<p>{LONG}</p>{after}<div class='{name}'><p>{MORE * 3}</p><p>{MORE}</p></div>") == LONG


@pytest.mark.parametrize(
    "inner",
    [
        "<p class='notice'>" + MORE + "</p>",
        "<p class='notice'>" + MORE + "<p>",
        "<span class='advert'>" + MORE + "<span>more</span></span>",
        "<h2 class=ad>Buy now</h2>",
        "<ul><li class='sponsored'>" + MORE + "</li></ul>",
    ],
)
def test_names_of_any_element(inner):
    assert blocks.main_text(f"<article><p>{LONG}</p>{inner}<p>{LONG}</p></article>") == f"{LONG} {LONG}"
    assert blocks.main_text(f"<article><p>Some {inner if inner.startswith('<span') else ''}text of it. {LONG}</p></article>") == f"Some text of it. {LONG}"


def test_paragraphs_of_links_stay_in_the_article():
    links = ", ".join(f"<a href=/{i}>The name of page {i}</a>" for i in range(6))
    text = ", ".join(f"The name of page {i}" for i in range(6))
    assert blocks.main_text(f"<article><p>{LONG}</p><p>{links}</p><p>{LONG}</p></article>") == f"{LONG} {text} {LONG}"


@pytest.mark.parametrize("text", ["Il gatto è salito sul tetto della casa mentre pioveva forte, poi scese piano e andò a dormire vicino al fuoco acceso.", "这是一个没有停用词表的语言的段落，它仍然是页面的正文。" * 4, "One short paragraph."])
def test_text_without_stop_words(text):
    assert blocks.main_text(f"<nav><a href=/>Home</a></nav><div><p>{text}</p></div><ul><li><a href=/x>A link</a></li></ul><footer>(c)</footer>") == text


def test_quotes_inside_unquoted_values():
    assert blocks.main_text(f"<article><p title=it's>{LONG}</p><p data-x=\"a>b\" title='c>d'>{LONG}</p></article>") == f"{LONG} {LONG}"
    assert blocks.main_text("<p " + "a=\"b\" c='d' " * 20000) == ""  # no tag is tried twice
    assert blocks.main_text("<script " + "a=\"b\" c='d' " * 20000) == ""


def test_second_pass_inherits():
    labels = [blocks.BAD, blocks.SHORT, blocks.GOOD, blocks.NEAR, blocks.SHORT, blocks.GOOD, blocks.SHORT]
    assert blocks.second_pass(labels, [False] * 7) == ["bad", "bad", "good", "good", "good", "good", "bad"]
    assert blocks.second_pass(labels, [False, True, *[False] * 5])[1] == "good"


def test_pages(spark):
    rows = [(1, "u", PAGE.format(open="<main>", close="</main>"), "t"), (2, None, None, None), (None, "u", "", None), (3, "u", "plain", "t"), (3, "u", "plain", "t"), (4, "v", "<p>" * 3000 + "x", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = blocks.extract(pages).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in got) == [("1", len(TEXT)), ("2", 0), ("3", 5), ("3", 5), ("4", 1), ("None", 0)]
    assert blocks.extract(pages.limit(0)).count() == 0


def test_warc(spark):
    rows = [(1, "u", "same"), (2, "u2\r\nx: y", "same"), (3, None, "own"), (4, "u", None), (5, "u", ""), (None, "u", "same"), (2, "u2\r\nx: y", "same"), (6, "u", "é\r\n\r\n" * 2000), (7, "u", "WARC/1.1\r\n\r\n")]
    pages = spark.createDataFrame([(*r, 1, "a") for r in rows], "page_id long, url string, html string, sum long, payload string")
    normal = warc.normalise(warc.write_archives(warc.with_originals(pages)))
    got = warc.read_archives(normal).collect()
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        largest = max(p for p, _, h in rows if p is not None and (h or "").encode() == data)
        revisit = page != largest
        want.append((page, len(data), warc.sha1_base32(data), "revisit" if revisit else "response", largest if revisit else None))
    key = lambda r: tuple(map(str, r))
    assert sorted([tuple(r)[:5] for r in got], key=key) == sorted(want, key=key)
    assert warc.read_archives(warc.normalise(warc.write_archives(warc.with_originals(pages.limit(0))))).count() == 0


def test_warc_reads_any_member_layout(tmp_path):
    import gzip

    records = [warc._record(i, "u", b"x" * i, None, "d") for i in range(40)]
    path = tmp_path / "a.gz"
    path.write_bytes(gzip.compress(b"".join(records[:7])) + gzip.compress(b"".join(records[7:])))
    assert list(warc.split_records(warc.inflate(f"file://{path}"))) == records


def test_warc_that_is_cut_raises(tmp_path):
    import gzip

    records = [warc._record(i, "u", b"x" * 5000, None, "d") for i in range(3)]
    whole = gzip.compress(b"".join(records))
    members = b"".join(gzip.compress(r) + b"\0" * 7 for r in records)
    path = tmp_path / "a.gz"
    path.write_bytes(members)
    assert list(warc.split_records(warc.inflate(f"file://{path}"))) == records
    for data in (whole[:-40], whole[:-4], members[: len(members) // 2], gzip.compress(b"".join(records)[:-900]), whole[:5]):
        path.write_bytes(data)
        with pytest.raises((ValueError, zlib.error)):
            list(warc.split_records(warc.inflate(f"file://{path}")))


def test_warc_inflates_in_bounded_blocks(tmp_path):
    import gzip

    path = tmp_path / "a.gz"
    path.write_bytes(gzip.compress(bytes(50_000_000)))
    sizes = [len(b) for b in warc.inflate(f"file://{path}")]
    assert sum(sizes) == 50_000_000 and max(sizes) <= warc._BLOCK


def test_warc_of_other_writers(spark, tmp_path):
    import gzip

    def foreign(i):
        block = b"HTTP/1.1 200 OK\r\ncontent-length: 2\r\n\r\nok"
        lines = [b"WARC/1.0", b"content-length:%d" % len(block), b"Warc-Type: response", b"WARC-RECORD-ID: <urn:x:" + b"long" * 30 + b"%d>" % i, b"X-Page-ID: %d" % i]
        lines += [b"warc-payload-digest: sha1:", b"  " + warc.sha1_base32(b"ok").encode()]
        return b"\r\n".join(lines).replace(b"sha1:\r\n  ", b"sha1:") + b"\r\n\r\n" + block + b"\r\n\r\n" * (1 + i % 2)

    path = tmp_path / "b.warc.gz"
    other = b"WARC/1.0\r\nWARC-Type: continuation\r\nWARC-Record-ID: <urn:y>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    path.write_bytes(gzip.compress(b"".join(foreign(i) for i in range(5000))))
    normal = warc.normalise(spark.createDataFrame([(f"file://{path}", 5000)], "path string, records long"))
    rows = warc.read_archives(normal).collect()
    assert sorted(r.page_id for r in rows) == list(range(5000)) and {r.payload_bytes for r in rows} == {2}
    path.write_bytes(gzip.compress(other + foreign(1)))
    [(file, n)] = warc.normalise(spark.createDataFrame([(f"file://{path}", 2)], "path string, records long")).collect()
    import pyarrow.parquet as pq

    index = pq.read_table(file.removeprefix("file://") + ".idx").to_pydict()
    assert n == 2 and index["type"] == ["continuation", "response"]
