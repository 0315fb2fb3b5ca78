import itertools
import re

import numpy as np

from lexforge.llm import licenses as lic


def predict(model, text):
    z = np.array(model.bias)
    for g in lic.grams(lic.tokens(text)):
        z = z + np.array(model.weights.get(g, [0.0] * len(z)))
    z = z / model.temperature
    p = np.exp(z - z.max())
    return model.families[int(p.argmax())], float((p / p.sum()).max())


NEGATIVES = [lic.tokens(t) for t in ["the house stands under a hill of stone and the river", "and this is for the terms we use in general", "a plain paragraph of the book with many words"] * 40]
MODEL = lic.fit(NEGATIVES)


def test_held_out_accuracy():
    held = lic.examples(seed=99)
    right = sum(predict(MODEL, " ".join(words))[0] == family for words, family, _ in held)
    assert right / len(held) > 0.95, right / len(held)


def test_licences_that_the_fit_has_not_seen_are_unknown():
    names = ["Sleepycat License", "Q Public License 1.0", "Frobnitz Open License 3", "Nokia Open Source License", "Sun Industry Standards Source License"]
    got = [predict(MODEL, s.format(n)) for n in names for s in lic.SENTENCES[:4]]
    wrong = [x for x in got if x[0] not in (lic.UNKNOWN, lic.NONE) and x[1] >= lic.LEAST_PROBABILITY]
    assert len(wrong) <= 0.1 * len(got), wrong


def brute(texts):
    """What scan should say: runs of lines with a word of the model, their classes, and the best template's share."""
    compared = {g for f in lic.NAMES for t in lic.templates(f) for g in lic.grams(lic.tokens(t)) if " " in g or len(lic.tokens(t)) == 1}
    marks = {g for g in MODEL.weights if " " not in g}
    assert all(" " not in g or marks & set(g.split(" ")) for g in MODEL.weights)
    out = []
    for i, t in texts:
        lines = (t or "").split("\n")
        hit = [bool(marks & set(re.findall(r"[a-z0-9]+", x.lower()))) for x in lines]
        runs = [list(g) for on, g in itertools.groupby(range(len(lines)), key=lambda k: hit[k]) if on]
        for run in runs:
            have = sorted({g for k in run for g in lic.grams(lic.tokens(lines[k]))})
            z = np.array(MODEL.bias) + sum((np.array(MODEL.weights[g]) for g in have if g in MODEL.weights), np.zeros(len(MODEL.bias)))
            p = np.exp((z - z.max()) / MODEL.temperature)
            best = MODEL.families[int(p.argmax())]
            if best == lic.NONE or not any(g in MODEL.weights or g in compared for g in have):
                continue
            share = 0.0
            for t in lic.templates(best) if best in lic.NAMES else []:
                want = {g for g in lic.grams(lic.tokens(t)) if " " in g or len(lic.tokens(t)) == 1}
                share = max(share, len(want & set(have)) / len(want))
            sure = best != lic.UNKNOWN and p.max() / p.sum() >= lic.LEAST_PROBABILITY
            out.append((i, run[0], best if sure else lic.UNKNOWN, round(float(p.max() / p.sum()), 6), round(share, 6), bool(sure and share >= lic.LEAST_OVERLAP)))
    return sorted(out, key=str)


def test_scan_agrees_with_the_model(spark):
    texts = [
        "Some prose here.\nReleased under the MIT License.\nMore prose", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.",
        "This work is licensed under the GNU General Public License, version 3.", None, "", "\n\n", "All rights reserved.", "nothing of the kind\nat all",
        "a license of general terms", "x " * 20000 + "\nReleased under the MIT License.",
        "Intro\n\n" + lic.TEXTS["mit"][0].replace(", to deal", ",\nto deal").replace("use, copy", "use,\ncopy") + "\n" + lic.TEXTS["mit"][1] + "\nend of file?",
        "Licensed under the Eclipse Public License 2.0.", "This work is licensed under CC BY-ND 4.0.", "GNU Affero General Public License, version 3",
    ]
    rows = [(i, t, "z") for i, t in enumerate(texts)] + [(1, texts[1], "z"), (None, texts[2], "z")]
    got = lic.scan(spark.createDataFrame(rows, "doc_id long, text string, family string"), MODEL).collect()
    assert sorted(((r.doc_id, r.paragraph, r.family, round(r.probability, 6), round(r.overlap, 6), r.confirmed) for r in got), key=str) == brute([r[:2] for r in rows])
    sure = {(r.doc_id, r.family) for r in got if r.confirmed}
    assert {(0, "mit"), (1, "cc-by-nc"), (2, "apache"), (3, "gpl"), (10, "mit"), (11, "mit"), (None, "apache")} == sure


def test_the_sample_depends_on_rows_alone(spark, monkeypatch):
    monkeypatch.setattr(lic, "SAMPLE_DOCUMENTS", 5)
    rows = [(None, f"line {i} of a text\nReleased under the MIT License.\n\nlast {i} " + "y" * 9000) for i in range(40)] + [(3, None), (4, "")]
    one = lic.sample_paragraphs(spark.createDataFrame(rows, "doc_id long, text string"))
    two = lic.sample_paragraphs(spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(3))
    assert one == two and 0 < len(one) <= 10 and not any("mit" in w for w in one)
    assert lic.sample_paragraphs(spark.createDataFrame([(1, None)], "doc_id long, text string")) == []


def test_query_path_over_tables_of_every_kind(spark):
    rows = [(i, f"prose number {i} is here\nLicensed under the Apache License, Version 2.0.") for i in range(30)] + [(None, None), (7, "")]
    got = lic.scan_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.paragraph, r.family, r.confirmed) for r in got.collect()) == [(i, 1, "apache", True) for i in range(30)]
    assert lic.scan_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_empty_table(spark):
    assert lic.scan(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0
