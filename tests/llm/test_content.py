"""Decontamination, mixing, toxicity, licences and the pipeline."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphwright.llm import decontamination as dc, licences, mixing, toxicity as tx
from graphwright.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def frame(spark, rows, schema="doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema)


ITEM = ("A train leaves the old station at 9 hours and travels 120 km north to meet Alice near the wide river. "
        "How long does Alice wait if the train covers 60 km in every single hour of the trip?")


def test_reparameterised_questions_are_caught(spark):
    items = frame(spark, [(1, ITEM), (2, "two words"), (3, None), (4, ""), (1, ITEM), (None, ITEM)], "item_id bigint, text string")
    other = ITEM.replace("120", "400").replace("60", "75").replace("Alice", "Bob").replace("km", "miles")
    mixed = ITEM.replace("meet Alice", "meet Bob").replace("120", "90")  # Alice would be two people
    docs = frame(spark, [(1, "Some text before. " + ITEM + " And after."), (2, "Before. " + other), (3, "Start. " + mixed),
                         (4, "Trains leave stations. " + ITEM[:60]), (5, None), (6, "there are two words here"), (7, ITEM.upper())])
    got = {(r.doc_id, r.item_id): r for r in dc.matches(docs, items).collect()}
    assert got[1, 1].share == 1.0 and got[1, 1].n_exact == got[1, 1].n_windows
    assert got[2, 1].consistent and got[2, 1].share >= 0.8 and got[2, 1].n_exact < got[2, 1].n_joined
    assert (3, 1) not in got and (4, 1) not in got and (5, 1) not in got and got[6, 2].share == 1.0
    assert sorted(r.doc_id for r in dc.keep(docs, items).collect()) == [3, 4, 5, 6]


DENSE = [  # an item, the same with other numbers and names
    ("What is 12 plus 7 times 3 minus 4?", "What is 15 plus 9 times 2 minus 8?"),
    ("Tom has 12 apples. Tom gives 4 apples to Mary. How many apples has Tom now?",
     "Bob has 30 apples. Bob gives 11 apples to Sue. How many apples has Bob now?"),
    ("A car drives 120 km in 2 hours and then 90 km in 3 hours. What is its speed?",
     "A car drives 300 miles in 5 hours and then 80 miles in 4 hours. What is its speed?"),
]


def test_dense_and_name_led_questions_are_caught(spark):
    items = frame(spark, [(i, a) for i, (a, _) in enumerate(DENSE)], "item_id bigint, text string")
    docs = frame(spark, [(i, "Some words come before. " + b + " Other words follow.") for i, (_, b) in enumerate(DENSE)]
                 + [(10 + i, "some words. " + a.upper()) for i, (a, _) in enumerate(DENSE)]
                 + [(20, "Tom has 12 apples and Mary has 3 pears."), (21, "1 2 3 4 5 6 7 8 9 " * 50)])
    got = {(r.doc_id, r.item_id): r for r in dc.matches(docs, items).collect()}
    assert set(got) == {(i + k, i) for i in range(3) for k in (0, 10)}
    assert all(got[i, i].consistent and got[i, i].n_exact < got[i, i].n_joined for i in range(3))


def test_numbers_in_words_are_placeholders(spark):
    items = frame(spark, [(1, "Tom buys three apples for two dollars each and twelve pears. How much does he pay in all?"), (2, "yes"), (3, "Is it so or not?")],
                  "item_id bigint, text string")
    docs = frame(spark, [(1, "Before. Tom buys seven apples for nine dollars each and thirty pears. How much does he pay in all? After."),
                         (2, "Tom buys 7 apples for 9 dollars each and 30 pears. How much does he pay in all?"), (3, "yes, it is so"), (4, "Is it so or not? Yes."),
                         (5, "Ann sells three apples and two pears, and nobody pays in all the twelve shops.")])
    got = {(r.doc_id, r.item_id) for r in dc.matches(docs, items).collect()}
    assert got == {(1, 1), (2, 1), (3, 2), (4, 2), (4, 3)}
    assert sorted(r.doc_id for r in dc.keep(docs, items).collect()) == [3, 5]


def test_slots_are_bound_by_place_and_copy(spark):
    item = "Every week the coach lets Alice run 3 sprints 3 times a week and then asks how far Alice ran in the whole long month."
    copy = lambda name, a, b: item.replace("Alice", name).replace("3 sprints 3", f"{a} sprints {b}")
    longer = lambda t: t.replace("asks how", "asks us how")
    one, two = copy("Bob", 4, 5), copy("Sue", 6, 2)
    docs = frame(spark, [(1, "First: " + one), (2, f"Text. {one} {two}"), (3, f"Text. {two} More of it. {one}"),
                         (4, one.replace("far Bob", "far Sue")), (5, longer(one)), (6, f"{longer(one)} {longer(two)}")])
    got = {r.doc_id: r for r in dc.matches(docs, frame(spark, [(1, item)], "item_id bigint, text string")).collect()}
    assert set(got) == {1, 2, 3, 5, 6}
    assert all(got[k].consistent and got[k].share == 1.0 for k in (1, 2, 3))


def test_benchmark_passages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    words = lambda t: re.findall(r"[^\W]+", t.lower())
    grams = lambda t: {tuple(words(t)[i:i + 5]) for i in range(len(words(t)) - 4)}
    held = {d.doc_id: grams(d.text) for d in docs}
    want = {(d, i.item_id) for i in items for d, g in held.items() if len(grams(i.text) & g) >= 0.8 * len(grams(i.text))}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op2_decontamination"](spark, SF).collect()}
    assert want <= got and len(got - want) <= 0.05 * len(got)


def test_decontamination_of_odd_rows(spark, odd, none):
    items = frame(spark, [(1, "The quick brown fox jumps over the lazy dog near the quiet river bank today.")], "item_id bigint, text string")
    kept = dc.keep(odd, items)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 2
    assert dc.matches(none, items).count() == 0 and dc.matches(odd, items.limit(0)).count() == 0


def sources(spark):
    sizes = {"a": 700, "b": 200, "c": 80, "d": 20, None: 10}
    rows = [(i, "w " * 10, s) for i, s in enumerate(x for s, n in sizes.items() for x in [s] * n)]
    return frame(spark, [*rows, (-1, None, "empty"), (-2, "", "empty")], "doc_id bigint, text string, source string")


def test_mixing_meets_the_repetition_limit(spark):
    docs = sources(spark)
    w = {r.source: r for r in mixing.weights(docs, max_repeats=3.0).collect()}
    assert abs(sum(r.weight or 0 for r in w.values()) - 1) < 1e-9
    assert abs(w[None].repeats - 3.0) < 1e-6 and w["a"].repeats == 1.0 and w["empty"].weight is None
    rows = mixing.mix(docs, max_repeats=3.0).collect()
    given = {s: sum(r.source == s for r in rows) for s in w}
    for s, r in w.items():
        if r.weight:
            assert abs(given[s] - r.repeats * r.n_docs) <= max(2, 0.05 * r.n_docs)
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()} and given["empty"] == 2
    places = {}
    for r in rows:
        places.setdefault((r.source, r.mix_epoch), set()).add(r.mix_place)
    assert all(min(p) >= 1 for p in places.values())
    again = sorted((r.doc_id, r.mix_epoch, r.mix_place) for r in mixing.mix(docs.repartition(7), max_repeats=3.0).collect())
    assert again == sorted((r.doc_id, r.mix_epoch, r.mix_place) for r in rows)


def test_mixing_meets_the_entropy(spark):
    docs = sources(spark)
    w = [r.weight for r in mixing.weights(docs, max_repeats=None, target_entropy=0.8).collect() if r.weight]
    assert abs(-sum(x * math.log(x) for x in w) / math.log(len(w)) - 0.8) < 1e-6
    same = mixing.weights(docs, max_repeats=1.0).collect()
    assert all(abs(r.weight - r.share) < 1e-9 for r in same if r.weight)
    budget = {r.source: r.quota for r in mixing.weights(docs, max_repeats=None, budget=500.0).collect()}
    assert abs(sum(budget.values()) - 500) < 1e-6


def test_mixing_of_odd_rows(spark, odd, none):
    out = mixing.mix(odd)
    assert out.columns == [*odd.columns, "mix_epoch", "mix_place", "mix_weight"]
    assert {str(r.doc_id) for r in out.collect()} == {str(r.doc_id) for r in odd.collect()}
    assert mixing.mix(none).count() == 0


def test_grammar_scores_clauses_not_words():
    m = tx.ClauseMachine({"idiot$": 5.0, "moro": 4.0})
    score = lambda t: m.clause(tx.WORD.findall(t.lower()))
    assert score("an idiot") == 5.0 and score("idiots") == 0 and score("morons") == 4.0
    assert score("you idiot") > score("an idiot") > score("she said an idiot came") > 0
    assert score("not an idiot") < score("an idiot") and score("not that he ever was an idiot") > score("not an idiot")
    assert score("kill the process") == 0 and score("kill you") > 0
    assert m.features("a day. An idiot came. No more")[2] == math.log1p(1) and m.features(None) == m.features("") == (0, 0, 0, 0)
    assert m.features("vidiot") == (0, 0, 0, 0)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op9_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    part = [r for r in rows if r.held_out]
    assert len(part) > 50 and sum(r.predicted == r.toxic for r in part) / len(part) >= 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_toxicity_of_odd_rows(spark, odd, none):
    rng = random.Random(1)
    text = [" ".join(rng.choices(["blue", "house", "river", "stone"], k=8)) for _ in range(80)]
    train = frame(spark, [(i, t + (". You grobble" if i % 4 < 2 else "")) for i, t in enumerate(text)])
    labels = frame(spark, [(i, int(i % 4 < 2)) for i in range(80)] + [(None, 1), (500, None)], "doc_id bigint, toxic int")
    model = tx.fit(train, labels)
    assert "grobble$" in model.lexicon
    got = {r.doc_id: r for r in tx.score(odd.unionByName(odd.limit(1).withColumn("doc_id", F.lit(99).cast("bigint"))
                                                         .withColumn("text", F.lit("What a grobble."))), model).collect()}
    assert got[99].predicted == 1 and all(r.predicted == 0 for k, r in got.items() if k != 99)
    assert got[3].score == got[4].score and got[None].held_out is False
    assert tx.keep(odd, model).columns == odd.columns and tx.keep(odd, model).count() == odd.count()
    assert tx.score(none, model).count() == 0
    empty = tx.fit(train, labels.limit(0))
    assert {r.score for r in tx.score(odd, empty).collect()} == {0.0}


def test_licences_are_found_and_others_left_alone(spark, odd, none):
    texts = ["Plain words.\nReleased under the MIT License.\nMore words.", "This work is licensed under the GNU General Public License, version 3.",
             "Her driver license was released under the old name.", "licensed under cc by-nc 4.0", "The apache tribe and its free software.",
             "Licensed under the Apache License, Version 2.0."]
    docs = frame(spark, list(enumerate(texts))).unionByName(odd.select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 100))
    got = {(r.doc_id, r.line): (r.family, r.confirmed) for r in licences.scan(docs).collect()}
    assert got == {(0, 1): ("MIT", True), (1, 0): ("GPL-3.0", True), (3, 0): ("CC-BY-NC", True), (5, 0): ("Apache-2.0", True)}
    assert licences.scan(none).count() == 0


WRAPPED = {
    "MIT": """The MIT License (MIT)

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell""",
    "BSD": """ * Some rights reserved.
 *
 * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are
 * met:""",
    "GPL-3.0": """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.""",
    "ISC": """Some words of prose stand before the notice, without a blank line.
Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
And some words of prose follow.""",
}


def test_wrapped_notices_are_found(spark):
    plain = "The old house stood by the river.\nThe software was free for any person\nwho had a license to fish.\n"
    docs = frame(spark, [*enumerate(WRAPPED.values()), (10, plain * 20), (11, plain + "\n" + WRAPPED["MIT"] + "\n\n" + WRAPPED["GPL-3.0"]),
                         (None, WRAPPED["BSD"]), (12, "\n".join("Released under the MIT License." for _ in range(3)))])
    rows = licences.scan(docs).collect()
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.line, r.family) for r in rows)
    assert got == [(-1, 2, "BSD"), (0, 4, "MIT"), (1, 2, "BSD"), (2, 0, "GPL-3.0"), (3, 1, "ISC"), (11, 8, "MIT"), (11, 13, "GPL-3.0"),
                   (12, 0, "MIT"), (12, 1, "MIT"), (12, 2, "MIT")]
    assert all(r.confirmed and "\n" not in r.paragraph for r in rows)


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard_join", "decontamination", "mixing", "token_blocks"]
    model = tx.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), ~tx.held_out())
    toxic = {r.doc_id for r in tx.score(docs, model).where("predicted = 1").collect()}
    left = {r.doc_id for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{k}")
            docs = spark.read.parquet(f"{tmp_path}/{k}")
        ids = [r.doc_id for r in (docs if k < 4 else out).select("doc_id").collect()]
        if name == "toxicity":
            assert set(ids) == left - toxic
        if k < 3:
            assert len(ids) == len(set(ids))
        if name in ("mixing", "token_blocks"):
            assert set(ids) == left
        left = set(ids)
    assert QUERIES["op1_token_attribution"](spark, SF).count() > 0


@pytest.mark.parametrize("stage", range(4))
def test_stages_take_odd_and_empty_tables(spark, odd, none, stage):
    run = corpus_pipeline.STAGES[stage][1]
    assert run(spark, odd, SF).columns == odd.columns and run(spark, odd, SF).count() > 0
    assert run(spark, none, SF).count() == 0
