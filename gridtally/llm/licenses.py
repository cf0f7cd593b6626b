"""Licence scan by a positional index of rare template words, in Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridtally.llm.common import written

#: Phrases that give their label wherever they stand.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Label, opening words of the public licence notice, and the phrases it must hold.
TEMPLATES = [
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this"
        " software and associated documentation files the software to deal in the software"
        " without restriction including without limitation the rights to use copy modify merge"
        " publish distribute sublicense and or sell copies of the software",
        ["permission is hereby granted free of charge"],
    ),
    (
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file"
        " except in compliance with the license you may obtain a copy of the license at",
        ["in compliance with the license"],
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms"
        " of the gnu general public license as published by the free software foundation",
        ["under the terms of the gnu general public license"],
    ),
    (
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms"
        " of the gnu lesser general public license as published by the free software foundation",
        ["gnu lesser general public license"],
    ),
    (
        "agpl",
        "this program is free software you can redistribute it and or modify it under the terms"
        " of the gnu affero general public license as published by the free software foundation",
        ["gnu affero general public license"],
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are"
        " permitted provided that the following conditions are met",
        ["redistribution and use in source and binary forms"],
    ),
    (
        "mpl",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a"
        " copy of the mpl was not distributed with this file you can obtain one at",
        ["terms of the mozilla public license"],
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or"
        " without fee is hereby granted provided that the above copyright notice",
        ["permission to use copy modify and or distribute this software"],
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free"
        " to copy modify publish use compile sell or distribute this software",
        ["free and unencumbered software"],
    ),
    (
        "cc-by",
        "this work is licensed under a creative commons attribution 4 0 international license",
        ["creative commons attribution"],
    ),
    (
        "cc-by-sa",
        "this work is licensed under a creative commons attribution sharealike 4 0 international"
        " license",
        ["creative commons attribution sharealike"],
    ),
    (
        "cc0",
        "to the extent possible under law the author has waived all copyright and related or"
        " neighboring rights to this work",
        ["waived all copyright and related or neighboring rights"],
    ),
]

#: A file looks up this many of its words for each template, those in the fewest documents,
#: and all words of the phrases that the template must hold.
RAREST = 8
#: So many of a template's places must stand as in the template, relative to each other.
VOTES = 3

NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def phrase_places(norm: Column, n_words: Column, phrase: str) -> Column:
    """Struct of the number of places, the first and the last word; NULL without any.

    ``norm`` has one space before and after every word. It is cut before the second word
    of each place, so places that share a space are all found.
    """
    first, rest = phrase.split(" ", 1)
    parts = F.split(norm, f" {first}(?= {rest} )")
    found = F.struct(
        (F.size(parts) - 1).cast("long").alias("n"),
        spaces(F.element_at(parts, 1)).cast("long").alias("first"),
        (n_words - spaces(F.element_at(parts, -1))).cast("long").alias("last"),
    )
    return F.when(F.contains(norm, F.lit(f" {phrase} ")), found)


def license_scan(
    docs: DataFrame,
    templates: list[tuple[str, str, list[str]]] = TEMPLATES,
    *,
    rarest: int = RAREST,
    votes: int = VOTES,
) -> DataFrame:
    """One row for each row of ``docs``, repeated rows included.

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score. A
    NULL or empty text has no words, no places (first_word and last_word NULL), empty
    labels and score 0. ``score`` is 1 where a base phrase stands, else of its best template
    the share of places, of the words looked up for it, that stand as in the template. Each
    template is looked up by itself, so notices beside it and the text around it take no
    label away. Other columns of ``docs`` are not read; an empty table gives an empty result.

    The words of all templates are the index, a list as long as the templates are. Texts
    are read once; what is kept of them is written: the base result, the licence words
    of each file, and the words of those files that hold all words of some key phrase.
    Document frequencies come from all files.
    """
    vocabulary = sorted({w for _, text, _ in templates for w in text.split()})
    lowered = F.lower(F.coalesce(F.col("text"), F.lit("")))
    joined = F.trim(F.regexp_replace(lowered, NO_WORD, " "))
    rows = (
        docs.select("doc_id", joined.alias("joined"))
        .withColumn("norm", F.concat(F.lit(" "), "joined", F.lit(" ")))
        .withColumn(
            "n_words",
            F.when(F.col("joined") == "", F.lit(0)).otherwise(spaces(F.col("norm")) - 1).cast("long"),
        )
        .withColumn("known", F.array_intersect(F.split("joined", " "), strings(vocabulary)))
    )
    norm, n_words = F.col("norm"), F.col("n_words")
    places = [phrase_places(norm, n_words, p).alias(f"p{i}") for i, p in enumerate(PHRASES)]
    keys = [sorted({w for phrase in must for w in phrase.split()}) for _, _, must in templates]
    possible = F.lit(False)
    for words in keys:
        possible |= F.size(F.array_except(strings(words), F.col("known"))) == 0
    names = [f"p{i}" for i in range(len(PHRASES))]
    stored = written(
        rows.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            "n_words",
            "known",
            F.when(possible, norm).alias("norm"),
            *places,
        ).select(
            "row",
            "doc_id",
            "n_words",
            sum((F.coalesce(F.col(f"{p}.n"), F.lit(0)) for p in names), F.lit(0)).cast("long").alias("n_base"),
            F.least(*[F.col(f"{p}.first") for p in names]).alias("first_word"),
            F.greatest(*[F.col(f"{p}.last") for p in names]).alias("last_word"),
            F.array_compact(
                F.array(*[F.when(F.col(p).isNotNull(), F.lit(label)) for p, label in zip(names, PHRASES.values(), strict=True)])
            ).alias("base"),
            "known",
            "norm",
        ),
        "licences",
    )
    method = template_labels(stored, templates, rarest, votes)
    labels = F.coalesce(F.col("found"), strings([]))
    return stored.select("row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base").join(method, "row", "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", labels)), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def template_labels(
    stored: DataFrame, templates: list[tuple[str, str, list[str]]], rarest: int, votes: int
) -> DataFrame:
    """row, found (labels) and share (of the looked-up places) of the files that match."""
    spark = stored.sparkSession
    postings = spark.createDataFrame(
        [(w, t, q) for t, (_, text, _) in enumerate(templates) for q, w in enumerate(text.split())],
        "word string, template int, place int",
    )
    keys = [{w for phrase in must for w in phrase.split()} for _, _, must in templates]
    indexed = spark.createDataFrame(
        [
            (w, t, text.split().count(w), w in keys[t], len(keys[t]))
            for t, (_, text, _) in enumerate(templates)
            for w in sorted({*text.split(), *keys[t]})
        ],
        "word string, template int, places long, key boolean, keys long",
    )
    frequency = stored.select(F.explode("known").alias("word")).groupBy("word").agg(F.count("*").alias("files"))
    files = stored.where(F.col("norm").isNotNull()).select("row", "known", "norm")
    each = W.partitionBy("row", "template")
    looked_up = (
        files.select("row", F.explode("known").alias("word"))
        .join(frequency, "word")
        .join(indexed, "word")
        .withColumn("rank", F.row_number().over(each.orderBy("files", "word")))
        .withColumn("held", F.count(F.when(F.col("key"), 1)).over(each))
        .where((F.col("held") == F.col("keys")) & (F.col("key") | (F.col("rank") <= rarest)))
        .select("row", "template", "word", "places")
    )
    placed = files.select("row", F.posexplode(F.split(F.trim("norm"), " ")).alias("at", "word"))
    aligned = (
        placed.join(looked_up, ["row", "word"])
        .join(postings, ["template", "word"])
        .groupBy("row", "template", (F.col("at") - F.col("place")).alias("shift"))
        .agg(F.countDistinct("place").alias("votes"))
        .where(F.col("votes") >= votes)
        .groupBy("row", "template")
        .agg(F.max("votes").alias("votes"))
    )
    asked = looked_up.groupBy("row", "template").agg(F.sum("places").alias("asked"))
    verified = F.lit(False)
    label = F.lit(None).cast("string")
    for t, (name, _, must) in enumerate(templates):
        here = F.col("template") == t
        for phrase in must:
            here &= F.contains("norm", F.lit(f" {phrase} "))
        verified |= here
        label = F.when(F.col("template") == t, F.lit(name)).otherwise(label)
    return (
        aligned.join(files.select("row", "norm"), "row")
        .where(verified)
        .join(asked, ["row", "template"])
        .groupBy("row")
        .agg(
            F.collect_set(label).alias("found"),
            F.max(F.col("votes") / F.col("asked")).alias("share"),
        )
    )
