"""Approximate title matching: Ratcliff-Obershelp similarity of at least 0.6, three best for each request.

Odd input: null requests and titles match nothing; a repeated request is answered once; an empty table on either side
gives no match; ties go to the title that sorts last; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CUTOFF, BEST, BLOCK = 0.6, 3, 1024


def close_titles(requests: DataFrame, titles: DataFrame, cutoff: float = CUTOFF, n: int = BEST) -> DataFrame:
    """request, rank, title, ratio. requests(request), titles(title); repeated titles are repeated candidates.

    Each distinct title is compared once; requests are taken in blocks. Lengths
    bound the ratio, so most titles are never compared letter by letter.
    """
    spark = titles.sparkSession
    distinct = titles.filter("title is not null").groupBy("title").agg(F.count(F.lit(1)).alias("copies"))
    wanted = (r.request for r in requests.filter("request is not null").distinct().toLocalIterator())
    out = None
    while some := list(islice(wanted, BLOCK)):
        block = spark.sparkContext.broadcast(some)

        def run(batches: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for request in block.value:
                    match = SequenceMatcher()
                    match.set_seq2(request)
                    for title, copies in zip(batch["title"], batch["copies"]):
                        if 2 * min(len(title), len(request)) < cutoff * (len(title) + len(request)):
                            continue
                        match.set_seq1(title)
                        if match.quick_ratio() >= cutoff and (ratio := match.ratio()) >= cutoff:
                            rows.append((request, title, copies, ratio))
                yield pd.DataFrame(rows, columns=["request", "title", "copies", "ratio"])

        part = distinct.mapInPandas(run, "request string, title string, copies long, ratio double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "request string, rank int, title string, ratio double")
    order = Window.partitionBy("request").orderBy(F.desc("ratio"), F.desc("title"))
    best = out.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= n)
    each = best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(n)))))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("request").orderBy("k", "copy")).cast("int"))
    return ranked.filter(F.col("rank") <= n).select("request", "rank", "title", "ratio")
