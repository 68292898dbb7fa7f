"""Terms of a table in texts: one pass over each text for all terms, however many there are."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegrid.storage import materialize

from .rank import small

#: Characters of the terms that are sent and looked for at once. There is another pass over the texts for every further part.
PART_CHARS = 1 << 22
#: Texts whose terms a worker holds at once. A text may have any number of terms, and an Arrow batch ten thousand texts.
ROWS = 64


def with_terms(texts: DataFrame, text: str, terms: DataFrame, term: str, name: str = "terms") -> DataFrame:
    """texts with name, the terms that the text contains, each once and in order.

    A null text has none; null and empty terms are in no text. Terms are sent to the tasks in parts of bounded size and a
    part's automaton goes over the texts once, so nothing is shuffled. A column called name is an error.
    """
    if name in texts.columns:
        raise ValueError(f"there is a column {name}")
    wanted = terms.select(F.col(term).cast("string").alias("t")).where("t <> ''").distinct()
    parts = max(1, -(-int(wanted.agg(F.sum(F.length("t"))).first()[0] or 0) // PART_CHARS))
    at = texts.columns.index(text)
    out = texts.withColumn(name, F.array().cast("array<string>"))
    for p in range(parts):
        some = [r["t"] for r in wanted.where(F.pmod(F.xxhash64("t"), F.lit(parts)) == p).collect()]  # a part, of bounded size
        if not some:
            continue
        sent = texts.sparkSession.sparkContext.broadcast(some)

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for t in sent.value:
                automaton.add_word(t, t)
            automaton.make_automaton()
            for whole in batches:
                for i in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(i, ROWS)
                    before = batch.column(batch.num_columns - 1)
                    found = [sorted({*was.as_py(), *(t for _, t in automaton.iter(x.as_py() or ""))}) for x, was in zip(batch.column(at), before, strict=True)]
                    yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, before.type)], schema=batch.schema)

        # One automaton at a time in a worker: passes don't follow each other within a stage.
        out = (materialize(out, "terms") if p else out).mapInArrow(run, out.schema)
    return out


def document_type_scores(docs: DataFrame, key: str, text: Column, terms: DataFrame) -> DataFrame:
    """(key, score, slot) as rules.document_type_score gives them, by a table (slot, term, strong) of any size.

    key tells the documents apart. 3 for any strong term of a slot and 1 for each supporting row; white space in texts doesn't
    count. A best score under 3, or one that slots share, is unknown.
    """
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")
    found = with_terms(docs.select(key, bare.alias("bare_")), "bare_", terms, "term", "terms_").select(key, F.explode_outer("terms_").alias("term"))
    hits = found.join(small(terms.select("slot", "term", "strong")), "term", "left")
    strong, weak = F.max(F.when(F.col("strong"), 3).otherwise(0)), F.sum(F.when(~F.col("strong"), 1).otherwise(0))
    scores = hits.groupBy(key, "slot").agg((strong + weak).cast("int").alias("score"))
    # Of a document's slots the best score, how many have it, and one of them: a slot a row, and slots are few.
    best = scores.groupBy(key).agg(F.max(F.struct("score", "slot")).alias("b"), F.collect_list("score").alias("all_"))
    tied = F.size(F.filter("all_", lambda x: x == F.col("b.score"))) > 1
    return best.select(key, F.col("b.score").alias("score"), F.when((F.col("b.score") < 3) | tied, "unknown").otherwise(F.col("b.slot")).alias("slot"))
