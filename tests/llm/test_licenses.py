import random
import re

import numpy as np

from eventledger.llm import licenses

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    at, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        hits = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        at += hits
        labels |= {label} if hits else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


MIT = licenses.TEMPLATES["mit-text"].replace("[", "(").replace("]", ")")
CASES = {
    "": set(),
    None: set(),
    "x Under the MIT License. Under, the (MIT) license!": {"mit", "mit-line"},
    "Licensed under the Apache License, Version 2.0.": {"apache-2", "apache-2-line"},
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.': {"apache-2", "apache-2-line", "apache-2-notice"},
    "under CC-BY-NC 4.0, and cc by nc": {"cc-by-nc", "cc-by-nc-line"},
    MIT: {"mit-text"},
    MIT.replace("(the software)", ""): {"mit-text"},
    MIT.replace("without restriction", "with restriction"): set(),
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License": {"gpl-notice"},
    "Copyright (c) 2020 The Authors of It. All rights reserved.": {"rights-reserved"},
    "copyright one two three four five six seven eight nine ten all rights reserved": set(),
    "SPDX-License-Identifier: BSD-3-Clause": {"spdx-line"},
    "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License": {"cc-notice"},
    "under the mit": set(),
    "the mit license apache license version 2": {"apache-2"},
    "under the apache license version 2 " * 5000: {"apache-2"},
}


def test_templates_and_phrases(spark):
    texts = list(CASES)
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(2, texts[2], "x")]
    found = licenses.licenses(spark.createDataFrame(rows, "doc_id long, text string, score string")).collect()
    assert len(found) == len(rows)
    for r in found:
        text = texts[r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(text), text
        assert r.labels == ",".join(sorted(CASES[text])), text
        assert 0 <= r.score <= 1 and (r.score == 1) == bool(CASES[text] or (text or "").startswith("x"))
    partial = next(r for r in found if texts[r.doc_id] == MIT.replace("without restriction", "with restriction"))
    assert 0.3 < partial.score < 1
    assert licenses.licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain(label):
    """The shortest text of a template."""
    text = re.sub(r"\[[^\]]*\]", "", licenses.TEMPLATES[label])
    return re.sub(r"\{(\d)-\d+\}", lambda m: "x " * int(m[1]), text)


def test_license_texts_are_matched_to_their_end(spark):
    whole = ["mit-text", "mit-0-text", "json-text", "bsd-2-text", "bsd-3-text", "bsd-4-text", "isc-text", "0bsd-text", "apache-2-notice-full"]
    also = {"apache-2-notice-full": {"apache-2", "apache-2-line", "apache-2-notice"}}
    cases = {}
    for label in whole:
        text = plain(label)
        words = text.split()
        cases[text] = {label} | also.get(label, set())
        for altered in (words[:-1], words[:-12] + ["other"] + words[-11:], words[: len(words) // 2], [*words[:-30], "but", "not", "for", "sale", *words[-30:]]):
            cases[" ".join(altered)] = also.get(label, set())
    for kind, label in (("", "gpl"), ("Lesser ", "lgpl"), ("Affero ", "agpl")):
        cases[f"This work is licensed under the GNU {kind}General Public License, version 3."] = {f"{label}-line"}
        cases[f"Under the terms of the GNU {kind}General Public License version 2.1"] = {f"{label}-line"}
        notice = f"x is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation, either version 3 of the License"
        cases[notice + ", or (at your option) any later version."] = {f"{label}-notice", f"{label}-or-later-notice"}
    cases["under the GNU General Public License of today, version 3"] = set()
    rows = list(enumerate(cases))
    found = {r.doc_id: r for r in licenses.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        assert found[i].labels == ",".join(sorted(cases[text])), text
        assert (found[i].score == 1) == bool(cases[text]), text


STATEMENTS = {
    r"This work is licensed under the GNU General Public License, version \d": "gpl-line",
    r"Licensed under CC BY-NC \d": "cc-by-nc-line",
    r"Released under the MIT License": "mit-line",
    r"Licensed under the Apache License, Version \d": "apache-2-line",
}


def test_every_license_statement_of_the_tables_has_a_label(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    found = {r.doc_id: set(r.labels.split(",")) for r in licenses.op6_licenses(spark, sf).collect()}
    seen = 0
    for i, text in texts.items():
        wanted = {label for statement, label in STATEMENTS.items() if re.search(statement, text)}
        assert wanted <= found[i], text
        assert wanted or "licen" not in text.lower(), text
        seen += len(wanted)
    assert seen


def test_query_on_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = licenses.op6_licenses(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(texts[r.doc_id])


def as_regex(markup):
    """A template as a regular expression over words that each end with a blank."""
    out = ""
    for token in re.findall(r"\[|\]|\{\d+-\d+\}|[^\s\[\]{}]+", markup):
        gap = re.fullmatch(r"\{(\d+)-(\d+)\}", token)
        out += "(?:" if token == "[" else ")?" if token == "]" else rf"(?:\S+ ){{{gap[1]},{gap[2]}}}" if gap else re.escape(token) + " "
    return re.compile(rf"(?<!\S){out}")


def test_labels_equal_regular_expressions(spark, sf):
    """All templates on whole tables, and on texts made of their pieces: left out, replaced, cut short, run together."""
    rng, texts = random.Random(6), [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for markup in licenses.TEMPLATES.values():
        for _ in range(6):
            kept = re.sub(r"\[([^\]]*)\]", lambda m: m[1] if rng.random() < 0.5 else "", markup)
            kept = re.sub(r"\{(\d+)-(\d+)\}", lambda m: " ".join(rng.choice(["Acme", "x", "3", "the"]) for _ in range(rng.randrange(int(m[1]), int(m[2]) + 2))), kept)
            w = kept.split()
            if rng.random() < 0.4:
                w[rng.randrange(len(w))] = rng.choice(["other", ""])
            texts.append(" ".join([*("so it is".split() * rng.randrange(3)), *w[: len(w) if rng.random() < 0.8 else rng.randrange(len(w))], "end."]))
    texts += [" ".join(rng.choice(texts[-150:]) for _ in range(3)) for _ in range(60)]
    plain = {label: as_regex(markup) for label, markup in licenses.TEMPLATES.items()}
    rows = licenses.licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    some = 0
    for r in rows:
        words = "".join(w + " " for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (texts[r.doc_id] or "").translate(LOWER)))
        want = {label for label, p in plain.items() if p.search(words)} | set(r.base_labels.split(","))
        assert set(r.labels.split(",")) - {""} == want - {""}, texts[r.doc_id]
        some += bool(r.labels)
    assert some > 100


def test_spdx_markup():
    text = """<<beginOptional>>The X License<<endOptional>>
        Permission is <<var;name="how";original="hereby";match=".{0,20}">> granted <<beginOptional>><<endOptional>>to (all)."""
    assert licenses.from_spdx(text, 3) == "[ the x license ] permission is {0-3} granted  to all"
    scanner = licenses.Scanner({"x": licenses.from_spdx(text, 3)}, {})
    scan = lambda s: scanner.scan(licenses.words_of(np.frombuffer(s.encode(), dtype=np.uint8), np.array([0, len(s.encode())]), licenses.ALNUM))[0][5]
    assert [scan(s) for s in ("Permission is granted to all", "the X license: permission is quite freely granted to all!", "permission is not ever at all granted to all", "permission is granted to")] == ["x", "x", "", ""]
