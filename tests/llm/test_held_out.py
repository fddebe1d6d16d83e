"""Held-out rows and texts that look like what is searched for: operators 2, 3 and 4."""

import pytest
from pyspark.sql import functions as F

from quarry.llm import langid, licences, queries, toxicity

DATA = "/root/testdata/sf0.01"


def test_language_clashing_names_and_rejection(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    clash = docs.withColumns({c: F.lit(1) for c in ("l", "share", "long", "id", "aside", "n", "short")})
    model, other = (langid.train(langid.sample(d, queries.remainder(3) != 1, "doc_id", "lang", "text")) for d in (docs, clash))
    assert model["langs"] == other["langs"] and model["limits"] == other["limits"]
    held = langid.predict(clash.where(queries.remainder(3) == 1).withColumn("was", F.col("lang")), other).where("was is not null")
    right, rejected, n = held.agg(F.count_if(F.col("was") == F.col("lang_pred")), F.count_if("rejected"), F.count("*")).first()
    assert right >= 0.99 * n and rejected <= 0.025 * n  # from some twenty rows a language that are set aside


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
LIKE = [
    "You may not use this recipe except in compliance with common sense.",
    "The permission to park is hereby granted to any person free of charge.",
    "All rights are reserved by the author of this book",
    "He has a driving license and permission to park.",
    "Redistribution of wealth and use of sources are permitted subjects.",
    "This program of the evening is free: you can see it at the general public library.",
]


def test_licences_held_out(spark):
    plain = [f"The committee number {i} met by the river and spoke of boats and weather." for i in range(300)]
    # words of the templates in other orders of thought, and licences with other words around and in them
    planted = [(t, f) for f, ts in licences.TEMPLATES.items() for t in ts if len(licences.tokens(t)) > 6]
    held = [f"Note {i}: {t.replace(' the ', ' The ', 1)} See the file for details." for i, (t, _) in enumerate(planted)]
    texts = [*plain, *LIKE, MIT, *held, held[0], None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {}
    for r in licences.scan(docs, licences.train(docs.where(f"doc_id < {len(plain)}"))).collect():
        assert r.confirmed
        found.setdefault(r.doc_id, set()).add(r.family)
    first = len(plain) + len(LIKE)
    assert not [i for i in found if i < first], "plain prose is no licence"
    assert found[first] == {"mit"}
    right = sum(found.get(first + 1 + i) == {f} for i, (_, f) in enumerate(planted))
    assert right >= 0.95 * len(planted) and found.get(first + 1 + len(held)) == found.get(first + 1)


@pytest.mark.parametrize("text", ["such a $tupid idea", "du @rschloch", "what an 1d10t", "an 1d1ot, again", "ein Vollid1ot", "die іdiot", "id​iot"])
def test_folded_insults(text):
    assert toxicity.Matcher({toxicity.fold(w): v for w, v in toxicity.LEXICON.items()})(text)[1] == 1


@pytest.mark.parametrize("text", ["two trash cans", "a trash can", "clown fishes swim", "it costs $100", "3rd of May", "mail me@home.org", "10 boats", ""])
def test_spared(text):
    assert toxicity.Matcher({toxicity.fold(w): v for w, v in toxicity.LEXICON.items() if w != "clown"})(text)[1] == 0
