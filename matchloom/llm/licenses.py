"""License scan with a positional rare-token index, in DataFrame functions only.

The index is a table of postings by word: a template is posted under the word of its mandatory key phrase with the highest IDF
over the corpus, with the word's place, the key phrase, and the notice's other words with their places. A file is split into
words; those it has of the index's are kept with the words around them and looked up by a broadcast join, whose work follows the
hits and not the number of templates. Each posting shifted by its word's place is a candidate alignment. It stands if the whole key phrase
is found there, and the notice's other words at their places relative to it give the score. Every place of a key
phrase holds its rarest word, so none is missed.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import materialize, row_hash

#: What stands between words, once A-Z are lower-cased. Splitting there is much faster than extracting words.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """``words`` with the mandatory key phrase at ``start`` .. ``stop``; ``base`` templates count places."""

    label: str
    words: tuple[str, ...]
    start: int
    stop: int
    base: bool = False


def template(label: str, text: str, key: str, base: bool = False) -> Template:
    words, phrase = tuple(text.split()), tuple(key.split())
    at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
    return Template(label, words, at, at + len(phrase), base)


# Wordings of public licenses and their notices, as words.
TEMPLATES = (
    template("mit", "released under the mit license", "under the mit license", base=True),
    template("apache-2", "licensed under the apache license version 2 0", "apache license version 2", base=True),
    template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc", base=True),
    template("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    template("gpl-2", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "terms of the gnu general public license as published by"),
    template("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    template("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    template("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2"),
    template("epl-2", "made available under the terms of the eclipse public license 2 0", "eclipse public license 2"),
    template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "permission is hereby granted free of charge",
    ),
    template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistribution and use in source and binary forms",
    ),
    template("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "neither the name of the copyright holder nor the names of its contributors"),
    template("apache-2", "spdx license identifier apache 2 0", "license identifier apache 2"),
    template("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "use this file except in compliance with the license"),
    template("mit", "spdx license identifier mit", "license identifier mit"),
    template("gpl", "spdx license identifier gpl", "license identifier gpl"),
    template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    template("cc0", "to the extent possible under law waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software released into the public domain"),
    template("boost", "distributed under the boost software license version 1 0", "boost software license version 1"),
    template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages", "this software is provided as is without any express or implied warranty"),
    template("artistic-2", "this package is distributed under the artistic license 2 0", "artistic license 2"),
    template("ofl", "this font software is licensed under the sil open font license version 1 1", "sil open font license version 1"),
    template("wtfpl", "do what the fuck you want to public license", "what the fuck you want to public license"),
)


def _words(text: Column) -> Column:
    # lower() differs from lower-casing A-Z only within words, but for the Kelvin sign, which it makes a k.
    lower = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u00e9")))
    return F.filter(F.split(lower, BREAK), lambda w: w != "")


def rarity(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, int]:
    """Document frequencies of the key phrases' words: a row per word comes to the driver, whatever the input."""
    vocabulary = sorted({w for t in templates for w in t.words[t.start : t.stop]})
    known = F.array_distinct(F.filter(_words(F.col("text")), lambda w: w.isin(vocabulary)))
    counts = docs.select(F.explode(known).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return {r["word"]: r["n"] for r in counts.collect()}


POSTINGS = "array<struct<k: int, anchor: string, place: int, label: string, base: boolean, key: array<string>, n: int, rest: array<struct<away: int, word: string>>>>"


def index(counts: dict[str, int], templates: tuple[Template, ...] = TEMPLATES) -> list[dict]:
    """The postings. ``away`` is a word's place relative to the key phrase."""
    rows = []
    for k, t in enumerate(templates):
        key = t.words[t.start : t.stop]
        place = min(range(len(key)), key=lambda i: (counts.get(key[i], 0), key[i]))
        rest = [{"away": i - t.start, "word": w} for i, w in enumerate(t.words) if not t.start <= i < t.stop]
        rows.append({"k": k, "anchor": key[place], "place": place, "label": t.label, "base": t.base, "key": list(key), "n": len(t.words), "rest": rest})
    return rows


def word_hits(docs: DataFrame, postings: list[dict]) -> DataFrame:
    """``(doc_id, rh, n_words, hits)``: the places of anchors, each with the words around it as far as any template reaches, from ``first`` on."""
    anchors = sorted({p["anchor"] for p in postings})
    # How far before and after an anchor a template's words stand.
    before = max(p["place"] - min([0, *(r["away"] for r in p["rest"])]) for p in postings)
    after = max(max([len(p["key"]) - 1, *(r["away"] for r in p["rest"])]) - p["place"] for p in postings)
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash().alias("rh"), _words(F.col("text")).alias("words"))
    placed = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda x: x["word"].isin(anchors))
    first = lambda x: F.greatest(x["at"] - before, F.lit(0))
    near = lambda x: F.struct(x["word"].alias("word"), x["at"].alias("at"), first(x).alias("first"), F.slice("words", first(x) + 1, x["at"] - first(x) + after + 1).alias("near"))
    return words.select("doc_id", "rh", F.size("words").cast("long").alias("n_words"), F.transform(placed, near).alias("hits"))


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places of base key phrases; first_word and last_word are their smallest and largest start,
    null without any. labels has every template found. score is the best template's share of words found at
    its place at any of its alignments, 0 without any template, 1 for a whole one. Null texts count as empty, an empty table
    gives no rows, other columns are ignored. No text is shuffled; rows equal in doc_id and text have the same result.
    """
    postings = index(rarity(docs, templates), templates)
    places = materialize(word_hits(docs, postings), "places")
    # As many rows as templates.
    table = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(postings)), POSTINGS)))
    hits = places.select("doc_id", "rh", F.explode("hits").alias("h")).select("doc_id", "rh", "h.*").withColumnRenamed("word", "anchor")
    found = hits.join(F.broadcast(table), "anchor").withColumn("at", F.col("at") - F.col("place"))
    word = lambda away: F.get("near", F.col("at") + away - F.col("first"))
    stands = (F.col("at") >= F.col("first")) & (F.slice("near", F.greatest(F.col("at") - F.col("first"), F.lit(0)) + 1, F.size("key")) == F.col("key"))
    there = F.transform(F.filter(F.transform("rest", lambda r, i: F.struct((word(r["away"]) == r["word"]).alias("same"), i.alias("i"))), lambda x: x["same"]), lambda x: x["i"])
    # A row given twice has its places twice.
    standing = found.where(stands).select("doc_id", "rh", "k", "label", "base", "n", F.size("key").alias("size"), "at", there.alias("there")).dropDuplicates(["doc_id", "rh", "k", "at"])
    per = standing.groupBy("doc_id", "rh", "k", "label", "base", "n", "size").agg(
        F.count("*").alias("places"), F.min("at").alias("low"), F.max("at").alias("high"), F.size(F.array_distinct(F.flatten(F.collect_set("there")))).alias("more")
    )
    base = lambda c: F.when(F.col("base"), F.col(c))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    rated = per.groupBy("doc_id", "rh").agg(
        F.sum(base("places")).alias("n_base"), F.min(base("low")).alias("first_word"), F.max(base("high")).alias("last_word"),
        joined(base("label")).alias("base_labels"), joined("label").alias("labels"), F.max((F.col("size") + F.col("more")) / F.col("n").cast("double")).alias("score"),
    ).withColumnsRenamed({"doc_id": "d", "rh": "r"})
    return places.join(rated, F.expr("doc_id <=> d AND rh = r"), "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"),
    )


def licenses_sql(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """The same in DuckDB's SQL, by trying every word as a phrase's start."""
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    lists, shares, labels = [], [], []
    for k, t in enumerate(templates):
        key = t.words[t.start : t.stop]
        n = len(key)
        lists.append(f"list_filter(range(len(words) - {n - 1}), lambda i: words[i + 1 : i + {n}] = {quoted(key)}) AS at{k}")
        parts = [f"CAST(list_contains(list_transform(at{k}, lambda i: CASE WHEN i + {i - t.start} >= 0 THEN coalesce(words[i + {i - t.start + 1}], '') ELSE '' END), '{t.words[i]}') AS INT)" for i in range(len(t.words)) if not t.start <= i < t.stop]
        shares.append(f"CASE WHEN len(at{k}) > 0 THEN ({' + '.join([str(n), *parts])}) / {float(len(t.words))} ELSE 0.0 END")
        labels.append(f"CASE WHEN len(at{k}) > 0 THEN '{t.label}' END")
    base = [k for k, t in enumerate(templates) if t.base]
    starts = "list_concat(" + ", ".join(f"at{k}" for k in base) + ")" if len(base) == 2 else "flatten([" + ", ".join(f"at{k}" for k in base) + "])"
    joined = lambda ks: f"coalesce(array_to_string(list_sort(list_distinct(list_filter([{', '.join(labels[k] for k in ks)}], lambda x: x IS NOT NULL))), ','), '')"
    return f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM documents
), p AS (SELECT doc_id, words, {", ".join(lists)} FROM w)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len({starts}) AS BIGINT) AS n_base,
  CAST(list_min({starts}) AS BIGINT) AS first_word, CAST(list_max({starts}) AS BIGINT) AS last_word,
  {joined(base)} AS base_labels, {joined(range(len(templates)))} AS labels,
  round(CAST(greatest({", ".join(shares)}) AS DOUBLE), 6) AS score
FROM p"""
