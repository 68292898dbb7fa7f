"""N-gram Jaccard join: multiple-global-order prefix filtering, exact verification, connected components.

Texts with equal shingle sets are one class. Two sets that overlap enough share a token among the first few of either in
any fixed order of all tokens, so candidates must do so in several orders (by document frequency and a hash each); what a
pair's first shared token leaves room for must suffice too. The first order finds candidates, the others thin them, and
what is left is verified on the whole sets.

Components need no link twice: first every posting list is compared with its own leading members, which joins groups of
copies to a hub in as many pairs as members; then only pairs that the links so far don't connect are tried, one for every
two components first.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_prefix, hash_words, map_arrays, materialize, mix, sliced
from .keyed import chunk_answers, count_keys, in_chunks, sizes, totals_of, use_counts

#: Words of a shingle, and the similarity of a link in hundredths.
WORDS, PERCENT = 3, 90
#: A word's hash counts in a shingle with this multiplier's power for its place.
SPREAD = 0x9E3779B97F4A7C15
#: A shingle's frequency is that of all shingles whose hashes agree in so many bits more than the volume of text has: one
#: in some hundred shares it with another. As it depends on the shingle alone, the orders are the same everywhere.
RANK_BITS = 8
#: Members in a block of a posting list: they are compared with each other and with those of one other block in one go.
BLOCK = 256
#: Multipliers of the orders' hashes. The first order ranks by exact frequency, the others by its power of two.
ORDERS = [1, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Ascending distinct 64-bit hashes of each text's shingles; of the whole text if it has fewer words; none without words."""
    h, at = hash_words(texts)
    keys = _joined(h, words)
    out = []
    for begin, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if end - begin >= words:
            key = np.sort(keys[begin : end - words + 1])
            out.append(key[np.concatenate([[True], key[1:] != key[:-1]])])
        else:
            out.append(_joined(h[begin:end], end - begin) if end > begin else np.empty(0, np.uint64))
    return out


def _joined(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of so many words."""
    n = max(0, len(h) - width + 1)
    key = np.full(n, width, np.uint64)
    for k in range(width):
        key += h[k : k + n] * np.uint64(pow(SPREAD, k + 1, 1 << 64))
    return mix(key)


def digest(tokens: np.ndarray) -> bytes | None:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None


def least_shared(a: np.ndarray | int, b: np.ndarray | int, percent: int):
    """The overlap that sets of these sizes need."""
    return -((-percent * (a + b)) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n + 1 - -(-percent * n // 100)


def ranked(tokens: np.ndarray, frequency: np.ndarray, order: int) -> np.ndarray:
    """A rank of each token that is the same in all documents: rare ones first, then by the order's hash. Tokens of one
    rank are to be kept in the order of their values, so sorts are stable."""
    shown = np.minimum(frequency, np.uint64((1 << 24) - 1)) if order == 0 else np.frexp(frequency.astype(np.float64))[1].astype(np.uint64)
    return (shown << np.uint64(40)) | (mix(tokens * np.uint64(ORDERS[order])) >> np.uint64(24))


def _classes(docs: DataFrame, keys: list[str], text: str, words: int, prefix: str = "") -> DataFrame:
    """The key columns, size and digest of each row's set; prefix goes before the names of the last two."""

    def work(texts: pa.Array) -> tuple:
        sets = shingle_sets(texts, words)
        return [len(s) for s in sets], [digest(s) for s in sets]

    return map_arrays(docs, work, keys, text, [(f"{prefix}size_", pa.int64()), (f"{prefix}digest_", pa.binary())], f"{prefix}size_ long, {prefix}digest_ binary")


def _distinct_texts(docs: DataFrame, text: str, words: int, least: int) -> DataFrame:
    """(digest_, text): the texts with at least so many shingles, of equal sets the first in each task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in sliced(batches):
            keep, names = [], []
            for i, tokens in enumerate(shingle_sets(batch.column(0), words)):
                if len(tokens) >= least and (d := digest(tokens)) not in seen:
                    seen.add(d)
                    keep.append(i)
                    names.append(d)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), batch.column(0).take(pa.array(keep, pa.int64()))], names=["digest_", "text"])

    return docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "digest_ binary, text string")


_MEMBERS = "token long, member binary, size int, place int, heads binary, tokens binary"


def _members(docs: DataFrame, text: str, words: int, percent: int) -> DataFrame:
    """Two kinds of rows: postings (token, member, size, place) for every token of a set's prefix in the first order that
    another set has too; and, where token is null, the set itself with the heads of its prefixes in the other orders."""
    chosen = _distinct_texts(docs, text, words, -(-percent // (100 - percent)))
    chunks, parts, bits = sizes(docs.select(F.col(f"`{text}`").alias("text")))
    width = min(64, bits + RANK_BITS)

    def sets_of(rows: pa.Table) -> tuple[list[bytes], list[np.ndarray]]:
        first = {name: i for i, name in reversed(list(enumerate(rows["digest_"].to_pylist())))}
        names, texts = sorted(first), rows["text"].combine_chunks()
        sets = []
        for at in range(0, len(names), 200):
            sets += shingle_sets(texts.take(pa.array([first[x] for x in names[at : at + 200]], pa.int64())), words)
        return names, sets

    def buckets(sets: list[np.ndarray]) -> np.ndarray:
        return np.concatenate(sets) >> np.uint64(64 - width)

    def ask(rows: pa.Table) -> tuple[list[tuple[np.ndarray, np.ndarray]]]:
        return ([np.unique(buckets(sets_of(rows)[1]), return_counts=True)],)

    def use(rows: pa.Table, answers: pa.Table) -> pa.Table:
        names, sets = sets_of(rows)
        totals, keys = totals_of(answers)[0], np.unique(buckets(sets))
        out: dict[str, list] = {c: [] for c in ("token", "member", "size", "place", "heads", "tokens")}
        for name, tokens in zip(names, sets, strict=True):
            n = len(tokens)
            frequency = totals[np.searchsorted(keys, tokens >> np.uint64(64 - width))]
            p = prefix_length(n, percent)
            first = np.argsort(ranked(tokens, frequency, 0), kind="stable")[:p]
            shared = np.flatnonzero(frequency[first] > 1)
            if not len(shared):
                continue
            heads = [tokens[np.argsort(ranked(tokens, frequency, o), kind="stable")[:p]] for o in range(1, len(ORDERS))]
            k = len(shared)
            out["token"] += tokens[first[shared]].view(np.int64).tolist() + [None]
            out["member"] += [name] * (k + 1)
            out["size"] += [n] * (k + 1)
            out["place"] += shared.tolist() + [0]
            out["heads"] += [None] * k + [np.concatenate(heads).tobytes()]
            out["tokens"] += [None] * k + [tokens.tobytes()]
        kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return pa.table([pa.array(v, kind) for v, kind in zip(out.values(), kinds, strict=True)], names=list(out))

    chunked = in_chunks(chosen, chunks, "digest_")
    return use_counts(chunked, chunk_answers(count_keys(chunked, [parts], [width], ask)), use, _MEMBERS)


def _fits(size: int, place: int, sizes_: np.ndarray, places: np.ndarray, percent: int) -> np.ndarray:
    """Whether a member and others of a posting list may overlap enough, if the list's token is the first that they share."""
    close = (100 * np.minimum(size, sizes_) >= percent * np.maximum(size, sizes_))
    return close & (1 + np.minimum(size - place - 1, sizes_ - places - 1) >= least_shared(size, sizes_, percent))


def _led_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b), a < b, of each member of a posting list and the list's leading member, where both may overlap
    enough. A list has a leading member for each band of sizes, which is found by an aggregation and joined back, so that
    Spark can split a list that very many sets are in."""
    band = F.floor(F.log(F.col("size")) / math.log(100 / percent) / 2)
    listed = postings.withColumn("band", band)
    leads = listed.groupBy("token", "band").agg(F.min(F.struct("place", "member", "size")).alias("lead"), F.count("*").alias("n"))
    leads = materialize(leads.where("n > 1").select(F.col("token").alias("l_token"), F.col("band").alias("l_band"), "lead"), "jaccard-leads")
    met = listed.join(leads, (F.col("token") == F.col("l_token")) & (F.col("band") == F.col("l_band"))).where(F.col("member") != F.col("lead.member"))
    n, m = F.col("size"), F.col("lead.size")
    room = 1 + F.least(n - F.col("place"), m - F.col("lead.place")) - 1
    good = (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * room >= percent * (n + m))
    pair = [F.least("member", "lead.member").alias("a"), F.greatest("member", "lead.member").alias("b")]
    return met.where(good).select(*pair).distinct()


def _one_each(size: np.ndarray, place: np.ndarray, label: np.ndarray, percent: int, own: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For every two labels the first pair of a cell that fits."""
    done: dict[int, set[int]] = {}
    for i, good in _unlinked(size, place, label, percent, own):
        seen = done.setdefault(int(label[i]), set())
        _, first = np.unique(label[good], return_index=True)
        new = [int(j) for j in good[np.sort(first)] if int(label[j]) not in seen and int(label[i]) not in done.get(int(label[j]), ())]
        if new:
            seen.update(int(label[j]) for j in new)
            yield i, np.array(new)


def _unlinked(size: np.ndarray, place: np.ndarray, label: np.ndarray, percent: int, own: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """All pairs of a cell that fit and whose labels differ. own: which of the cell's two blocks a member is in."""
    for i in range(len(size) - 1):
        others = np.arange(i + 1, len(size))
        others = others[(label[others] != label[i]) & ((own[others] != own[i]) | (own[0] == own[-1]))]
        good = others[_fits(size[i], place[i], size[others], place[others], percent)] if len(others) else others
        if len(good):
            yield i, good


def _candidates(postings: DataFrame, labels: DataFrame, pairs_of: Callable, percent: int) -> DataFrame:
    """Distinct pairs (a, b), a < b, that pairs_of finds in the posting lists that have more than one label.

    A list is dealt out as cells, one for every two blocks of its members, so no task holds a whole long list. A member
    is in the cells of its block: as many copies as its list has blocks, which is one up to BLOCK members or so.
    """
    known = postings.join(labels.withColumnRenamed("node", "member"), "member", "left").withColumn("label", F.coalesce("label", "member"))
    known = materialize(known, "jaccard-labelled")
    lists = known.groupBy("token").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("low != high")
    lists = materialize(lists.select(F.col("token").alias("l_token"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "jaccard-lists")
    rows = known.join(lists, F.col("token") == F.col("l_token")).withColumn("own", F.pmod(F.xxhash64("member", F.lit(7)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = rows.select("token", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "member", "size", "place", "label")
    dealt = dealt.repartition("token", "x", "y").sortWithinPartitions("token", "x", "y", "own", "place", "member")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[bytes, bytes]] = set()

        def found(rows: pa.Table) -> pa.RecordBatch:
            member = rows["member"].to_pylist()
            size, place, own = (rows[c].to_numpy() for c in ("size", "place", "own"))
            label = rows["label"].combine_chunks().dictionary_encode().indices.to_numpy()
            edge = np.concatenate([[0], np.flatnonzero(changes(rows)) + 1, [len(member)]])
            new = []
            for x, y in zip(edge[:-1], edge[1:], strict=True):
                if y - x > 1:
                    for i, others in pairs_of(size[x:y], place[x:y], label[x:y], percent, own[x:y]):
                        for j in others:
                            pair = (member[x + i], member[x + j])
                            pair = pair if pair[0] < pair[1] else pair[::-1]
                            if pair not in seen:
                                if len(seen) > 500_000:
                                    seen.clear()
                                seen.add(pair)
                                new.append(pair)
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in new], pa.binary()), pa.array([p[1] for p in new], pa.binary())], names=["a", "b"])

        def changes(rows: pa.Table) -> np.ndarray:
            return np.any([np.diff(rows[c].to_numpy()) != 0 for c in ("token", "x", "y")], axis=0)

        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows
            at = np.flatnonzero(changes(rows))
            cut = int(at[-1]) + 1 if len(at) else 0  # the last cell may go on
            if cut:
                yield found(rows.slice(0, cut))
            held = rows.slice(cut)
        if held is not None and held.num_rows:
            yield found(held)

    return dealt.mapInArrow(run, "a binary, b binary").distinct()


def _first_shared(x: np.ndarray, y: np.ndarray) -> tuple[int, int] | None:
    """Places of the first token of x that y has too."""
    at = np.flatnonzero(np.isin(x, y))
    return (int(at[0]), int(np.flatnonzero(y == x[at[0]])[0])) if len(at) else None


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that link. sets: (member, size, heads, tokens). Heads are met first; only pairs that pass get whole sets."""

    def thin(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 200):
            keep = []
            for i, (n, m, x, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(2, 6)), strict=True)):
                p, q = prefix_length(n, percent), prefix_length(m, percent)
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                need = least_shared(n, m, percent)
                for o in range(len(ORDERS) - 1):
                    at = _first_shared(x[o * p : (o + 1) * p], y[o * q : (o + 1) * q])
                    if at is None or 1 + min(n - at[0] - 1, m - at[1] - 1) < need:
                        break
                else:
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 200):
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                if 100 * shared >= percent * (len(both) - shared):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    heads = sets.select("member", "size", "heads")
    met = pairs.join(heads.toDF("a", "size_a", "heads_a"), "a").join(heads.toDF("b", "size_b", "heads_b"), "b")
    thinned = materialize(met.select("a", "b", "size_a", "size_b", "heads_a", "heads_b").mapInArrow(thin, "a binary, b binary"), "jaccard-pairs")
    whole = sets.select("member", "tokens")
    met = thinned.join(whole.toDF("a", "tokens_a"), "a").join(whole.toDF("b", "tokens_b"), "b")
    return met.select("a", "b", "tokens_a", "tokens_b").mapInArrow(check, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b): the least node that it is connected to. Labels spread along edges and
    then jump to their own labels, so rounds grow with the logarithm of the longest path; every round is written."""
    both = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "component-edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "component-labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        ends = labels.select(F.col("node").alias("end"), F.col("label").alias("further"))
        jumped = materialize(new.join(ends, F.col("label") == F.col("end"), "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "component-labels")
        if jumped.where("label < old").isEmpty():
            return jumped.select("node", "label")
        labels = jumped.select("node", "label")


def _class_labels(docs: DataFrame, text: str, words: int, percent: int) -> DataFrame:
    """(node, label) of the set classes that have links.

    First every list is compared with its leading members; then one pair for every two labels that still meet in a list;
    then every pair whose labels still differ. After each step what is verified joins the links.
    """
    members = materialize(_members(docs, text, words, percent), "jaccard-members")
    postings = members.where(F.col("token").isNotNull()).select("token", "member", "size", "place")
    sets = members.where(F.col("token").isNull()).select("member", "size", "heads", "tokens")
    links = materialize(_verified(_led_pairs(postings, percent), sets, percent), "jaccard-links")
    labels = components(links)
    for pairs_of in (_one_each, _unlinked):
        more = materialize(_verified(_candidates(postings, labels, pairs_of, percent), sets, percent), "jaccard-links")
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = components(links)
    return labels


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """id, n_shingles, component_id, set_digest and group_digest (what names a component) of each row.

    component_id is the smallest id that links reach, the row's own included. Null, empty and blank texts have no shingles
    and link with nothing; a text of fewer words than a shingle has one. Rows that repeat an id with other texts are
    told apart by their sets; repeated rows come out each. Null ids are never the smallest, and null where a component has
    no other. Other columns aren't read. An empty table gives none. Shingles are told apart by 64-bit hashes.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id_"), F.col(f"`{text_col}`").cast("string").alias("text"))
    classes = materialize(_classes(rows, ["id_"], "text", words), "jaccard-classes")
    labels = _class_labels(rows, "text", words, percent)
    least = classes.where(F.col("digest_").isNotNull()).groupBy("digest_").agg(F.min("id_").alias("least"))
    least = least.join(labels, F.col("digest_") == F.col("node"), "left").withColumn("label", F.coalesce("label", "digest_"))
    # Written first, so that the join that takes it back can split a component with very many classes.
    least = materialize(least, "jaccard-least")
    grouped = materialize(least.groupBy("label").agg(F.min("least").alias("component")), "jaccard-components")
    found = least.join(grouped, "label").select(F.col("digest_").alias("class_"), "component", F.col("label").alias("group"))
    out = classes.join(found, F.col("digest_") == F.col("class_"), "left")
    component = F.when(F.col("digest_").isNull(), F.col("id_")).otherwise(F.col("component"))
    return out.select(F.col("id_").alias(id_col), F.col("size_").alias("n_shingles"), component.alias("component_id"), F.col("digest_").alias("set_digest"), F.col("group").alias("group_digest"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component, the one with the smallest id; all columns as they are.

    Texts without words all stay. Of rows that repeat both id and set, any one stays. Where a component has null ids only,
    one row stays.
    """
    own = free_prefix(docs.columns, "j_")
    found = materialize(link_components(docs, id_col, text_col, words, percent), "jaccard-components").where(F.col("set_digest").isNotNull())
    # The least id, null only if there is no other, and of its sets the least digest.
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("set_digest").alias("digest"))).alias("first")
    chosen = found.groupBy("group_digest").agg(first).select(F.col("first.id").alias(f"{own}keep_id"), F.col("first.digest").alias(f"{own}keep_digest"))
    rows = _classes(docs.withColumn(f"{own}text", F.col(f"`{text_col}`").cast("string")), docs.columns, f"{own}text", words, own)
    bare = rows.where(F.col(f"{own}digest_").isNull())
    best = rows.join(chosen, F.col(f"`{id_col}`").eqNullSafe(F.col(f"{own}keep_id")) & (F.col(f"{own}digest_") == F.col(f"{own}keep_digest")), "left_semi")
    if not found.groupBy(id_col, "set_digest").count().where("count > 1").isEmpty():
        best = best.dropDuplicates([id_col, f"{own}digest_"])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return best.select(*columns).unionByName(bare.select(*columns))
