"""Language-model scoring with a weighted backoff automaton, sharded by n-gram.

The model: words and bigrams counted over all training texts. A state is the last word read
(or a text's beginning); its arcs are the words seen after it, with weight
log10((c(v w) + A p(w)) / (c(v) + A)); its failure arc leads to the empty state with weight
log10(A / (c(v) + A)), from where w costs log10 p(w). p(w) = (c(w) + 1) / (N + V + 1) is the
add-one base, so a state's arcs and the words behind its failure arc sum to what the base
sums to. A word never seen after v takes the failure arc; after a word unknown in training
there is no weight on it.

The automaton grows with the corpus and is nowhere held whole. Texts are dealt into slices;
a slice sends each distinct key (word or bigram) it holds with its own training count to
the key's shard, the shards add the counts up, and send back to each slice the totals that
differ from its own: the part of the automaton that its texts can visit. There each text is
traversed once from left to right: the state reached is the word just read, whichever arc
led to it, so all steps of a slice are looked up side by side, and their weights summed by
text. A key that holds a third of all tokens is one entry a slice.

Cases: a null text counts as empty and has its end token only; a null id counts as the
empty string where the split is drawn; without training texts every word costs
log10(1 / 1) = 0; rows of equal id are scored row by row; an empty table gives an empty
table; other columns are not looked at. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from retenta.llm import slices
from retenta.llm.staging import text_of

#: the base's share in a state's distribution, counted in tokens
A = 300.0

END, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(7)) == 2


def tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice's texts: every token's key, the key of the bigram it ends, and the number
    of tokens of each text; a text's words, then its end."""
    flat, offsets = slices.documents_of(table)
    words, text_of_word = slices.word_hashes(flat, offsets)
    counts = np.bincount(text_of_word, minlength=table.num_rows) + 1
    ends = np.cumsum(counts) - 1
    token = np.empty(len(words) + table.num_rows, np.uint64)
    is_end = np.zeros(len(token), bool)
    is_end[ends] = True
    token[is_end], token[~is_end] = END, words
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[ends - counts + 1] = BEGIN
    return token, slices.mixed(token + slices.mixed(before + np.uint64(1))), counts


def _own(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, how often each occurs in training texts, and each place's key."""
    distinct, place = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(place[train], minlength=len(distinct)), place


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text: str = "text", slice_bytes: int = slices.SLICE_BYTES) -> DataFrame:
    """For each row: ``id_col``, train, n_tokens, n_known, train_tokens, base_score, score.
    ``train``: whether the model learns from the row."""
    n = slices.number_of(docs, text, slice_bytes)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_of(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    texts = slices.packed(rows.withColumn("slice", slices.dealt(n, "id", "text")), n)

    def ask(key: tuple, blocks: pa.Table) -> pa.Table:
        table = slices.unpacked(blocks.column("block"))
        token, bigram, counts = tokens(table)
        learn = table.column("train").to_numpy()
        train_token = np.repeat(learn, counts)
        out = {"shard": [], "slice": [], "kind": [], "keys": [], "counts": []}
        for kind, keys in ((1, token), (2, bigram)):
            distinct, own, _ = _own(keys, train_token)
            if kind == 2:  # the beginning's own count
                at = int(np.searchsorted(distinct, BEGIN))
                distinct, own = np.insert(distinct, at, BEGIN), np.insert(own, at, learn.sum())
            for shard, part in enumerate(slices.by_shard(distinct, n)):
                out["shard"].append(shard)
                out["slice"].append(key[0].as_py())
                out["kind"].append(kind)
                out["keys"].append(slices.pack_keys(distinct[part]))
                out["counts"].append(slices.pack_numbers(own[part]))
        return pa.table(out, pa.schema([("shard", pa.int32()), ("slice", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))

    def answer(asked: pa.Table) -> pa.Table:
        rows = asked.select(["slice", "kind"]).to_pylist()
        keys = [slices.unpack_keys(x.as_py()) for x in asked.column("keys")]
        counts = [slices.unpack_numbers(x.as_py()).astype(np.int64) for x in asked.column("counts")]
        out = {"slice": [], "kind": [], "keys": [], "counts": [], "tokens": [], "types": []}
        for kind in (1, 2):
            of = [i for i, r in enumerate(rows) if r["kind"] == kind]
            if not of:
                continue
            distinct, place = np.unique(np.concatenate([keys[i] for i in of]), return_inverse=True)
            total = np.bincount(place, np.concatenate([counts[i] for i in of]), minlength=len(distinct)).astype(np.int64)
            at = 0
            for i in of:
                sums = total[place[at : at + len(keys[i])]]
                at += len(keys[i])
                more = sums != counts[i]
                out["slice"].append(rows[i]["slice"])
                out["kind"].append(kind)
                out["keys"].append(slices.pack_keys(keys[i][more]))
                out["counts"].append(slices.pack_numbers(sums[more]))
                out["tokens"].append(int(total.sum()))
                out["types"].append(int((total > 0).sum()))
        return pa.table(out, pa.schema([("slice", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("tokens", pa.int64()), ("types", pa.int64())]))

    def traverse(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        table = slices.unpacked(blocks.column("block"))
        if table is None:
            return pa.table({c: [] for c in schema.names}, schema)
        token, bigram, counts = tokens(table)
        learn = table.column("train").to_numpy()
        train_token = np.repeat(learn, counts)
        kinds = answers.column("kind").to_numpy()
        # every shard answers every slice, so its sums over the shards are the corpus's
        n_train = int(answers.column("tokens").to_numpy()[kinds == 1].sum())
        n_types = int(answers.column("types").to_numpy()[kinds == 1].sum())

        def totals(kind: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            distinct, total, place = _own(keys, train_token)
            for i in np.flatnonzero(kinds == kind).tolist():
                found = slices.unpack_keys(answers.column("keys")[i].as_py())
                value = slices.unpack_numbers(answers.column("counts")[i].as_py())
                at = np.minimum(np.searchsorted(distinct, found), len(distinct) - 1)
                own = distinct[at] == found
                total[at[own]] = value[own].astype(np.int64)
                if kind == 2 and not own.all():
                    beginnings.append(int(value[~own][0]))
            return distinct, total, place

        beginnings: list[int] = []
        words, word_total, word_at = totals(1, token)
        _, bigram_total, bigram_at = totals(2, bigram)
        c_word, c_bigram = word_total[word_at], bigram_total[bigram_at]
        c_state = np.empty(len(token), np.int64)  # a word's count is how often it was left
        c_state[1:] = c_word[:-1]
        c_state[np.cumsum(counts) - counts] = beginnings[0] if beginnings else int(learn.sum())
        base = (c_word + 1) / (n_train + n_types + 1)
        weight = np.log10(np.where(c_bigram > 0, c_bigram + A * base, A * base) / (c_state + A))
        first = np.cumsum(counts) - counts
        sums = lambda x: np.add.reduceat(x, first)
        return pa.table(
            [table.column("id"), table.column("train"), counts.astype(np.int64), sums((c_word > 0).astype(np.int64)), np.full(len(counts), n_train), sums(np.log10(base)), sums(weight)],
            schema,
        )

    asked = texts.groupBy("slice").applyInArrow(ask, "shard int, slice int, kind int, keys binary, counts binary")
    answers = asked.groupBy("shard").applyInArrow(answer, "slice int, kind int, keys binary, counts binary, tokens long, types long")
    result = f"id {id_type}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    schema = pa.schema([("id", to_arrow_type(docs.schema[id_col].dataType)), ("train", pa.bool_())] + [(c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")] + [(c, pa.float64()) for c in ("base_score", "score")])
    out = texts.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(traverse, result)
    return out.withColumnRenamed("id", id_col)
