"""Token counts from per-document pre-token frequencies.

A BPE tokenizer splits a text into pre-tokens and encodes each alone, so a document's token count
is the sum over its distinct pre-tokens of frequency x pieces. No id is ever materialised:

1. one pass over the texts gives every document's pre-token frequencies;
2. frequent pre-tokens (a bounded table, fitted on a bounded sample and broadcast) are summed in
   that pass. The table decides only where a pre-token is summed, never the result;
3. every other pre-token is shuffled by its hash, its pieces are counted once per distinct
   pre-token, and the counts are joined to the frequencies and summed per document.

Results for odd input: a null or empty text has 0 bytes and 0 tokens; repeated rows (even equal
doc_id and text) give one row each; doc_id may be null; an empty table gives an empty result; other
columns of `docs` are ignored, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.common import checkpoint, lean, small_batches, table

#: Documents whose pre-tokens choose the broadcast table, and the most entries it may have.
SAMPLE_DOCS = 4000
HOT_PRETOKENS = 1 << 18

#: Characters for which lower() and the letter class below equal the tokenizer's own rules.
_PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
_PLAIN_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")


class PreTokens:
    """The pre-tokens of texts and the pieces of pre-tokens, for one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        added = self.tok.get_added_tokens_decoder().values()
        self.special = {a.content for a in added}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        probe = "A'SÉ aß9 x."
        self.plain_ok = self._by_library(probe) == self._by_pattern(probe) == ["a", "'s", "é", "aß", "9", "x", "."]

    def _by_pattern(self, text: str) -> list[str]:
        return _PLAIN_SPLIT.findall(text.lower())

    def _by_library(self, text: str) -> list[str]:
        if self.tok.normalizer is not None:
            text = self.tok.normalizer.normalize_str(text)
        # Byte-level symbols stand for bytes, so the offsets give the words themselves.
        return [text[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text)] if text else []

    def count(self, text: str) -> Counter:
        """Pre-token -> frequency; special strings keep their own names."""
        if self.plain_ok and _PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return Counter(self._by_pattern(text))
        out: Counter = Counter()
        for part in self._cut.split(text) if self._cut else [text]:
            if part in self.special:
                out[part] += 1
            elif part:
                out.update(self._by_library(part))
        return out

    def pieces(self, pretoken: str) -> int:
        if pretoken in self.special:
            return 1
        return sum(len(self.tok.model.tokenize(word)) for word, _ in self._bytes().pre_tokenize_str(pretoken))

    @lru_cache(maxsize=1)  # noqa: B019  one object per process and file
    def _bytes(self):
        from tokenizers import pre_tokenizers

        return pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)


@lru_cache(maxsize=4)
def _pretokens(path: str) -> PreTokens:
    return PreTokens(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def hot_pieces(docs: DataFrame, path: str, sample_docs: int = SAMPLE_DOCS, most: int = HOT_PRETOKENS) -> dict[str, int]:
    """Pieces of the commonest pre-tokens of a bounded sample of documents, at most `most` of them."""

    def seen(batches):
        pre, total = _pretokens(path), Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                total.update(pre.count(text or ""))
        top = total.most_common(most)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()), pa.array([v for _, v in top], pa.int64())], ["pretoken", "n"])

    # By hash, so a table in any order gives a sample of all of it.
    share = min(1.0, 2.0 * sample_docs / max(1, docs.count()))
    sample = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) <= share * (1 << 30)).limit(sample_docs)
    rows = sample.mapInArrow(lean(seen), "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pretoken").limit(most).collect()
    pre = _pretokens(path)
    return {r.pretoken: pre.pieces(r.pretoken) for r in rows}


def pretoken_frequencies(docs: DataFrame, path: str, hot: dict[str, int]) -> DataFrame:
    """(doc_id, n_bytes, mark, base, pretoken, n).

    One row per document with `base` true and in `n` the tokens of its pre-tokens in `hot`; one row
    per other pre-token of the document with its frequency. `mark`, 128 bits of a hash of
    the text, tells texts apart under one doc_id. A document row's pretoken is a space and a number: no pre-token holds a space,
    so it meets nothing in a join, and the numbers deal such rows out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def split(batches):
        pre, known = _pretokens(path), shared.value
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            src, size, marks, base, word, freq = [], [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                text = text or ""
                data = text.encode()
                tokens, rare = 0, []
                for k, n in pre.count(text).items():
                    p = known.get(k)
                    if p is None:
                        rare.append((k, n))
                    else:
                        tokens += p * n
                m, mark = len(rare) + 1, hashlib.blake2b(data, digest_size=16).digest()
                src += [ids[i]] * m
                size += [len(data)] * m
                marks += [mark] * m
                base += [True] + [False] * len(rare)
                word.append(f" {int.from_bytes(mark[:4], 'little') % 4096}")
                word += [k for k, _ in rare]
                freq.append(tokens)
                freq += [n for _, n in rare]
            yield pa.RecordBatch.from_arrays(
                [pa.array(src, pa.int64()), pa.array(size, pa.int64()), pa.array(marks, pa.binary()), pa.array(base, pa.bool_()), pa.array(word, pa.string()), pa.array(freq, pa.int64())],
                ["doc_id", "n_bytes", "mark", "base", "pretoken", "n"],
            )

    return docs.select("doc_id", "text").mapInArrow(lean(split), "doc_id long, n_bytes long, mark binary, base boolean, pretoken string, n long")


def count_tokens(docs: DataFrame, tokenizer_path: str | None = None, sample_docs: int = SAMPLE_DOCS, hot_pretokens: int = HOT_PRETOKENS) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row of `docs` (doc_id, text)."""
    small_batches(docs.sparkSession)
    path = tokenizer_path or default_tokenizer()
    # The texts are split once; the rare pre-tokens are read twice.
    freqs = checkpoint(pretoken_frequencies(docs, path, hot_pieces(docs, path, sample_docs, hot_pretokens)))

    @F.pandas_udf("long")
    def n_pieces(words):
        pre = _pretokens(path)
        return words.map(pre.pieces)

    vocabulary = freqs.where("not base").select(F.col("pretoken").alias("v_pretoken")).distinct().withColumn("pieces", n_pieces("v_pretoken"))
    joined = freqs.join(vocabulary, F.col("pretoken") == F.col("v_pretoken"), "left")
    per_text = joined.groupBy("doc_id", "n_bytes", "mark").agg(F.count_if("base").alias("copies"), F.sum(F.col("n") * F.coalesce(F.col("pieces"), F.lit(1))).alias("tokens"))
    # Equal rows were summed together; they share the sum.
    return per_text.select("doc_id", "n_bytes", (F.col("tokens") / F.col("copies")).cast("long").alias("n_tokens"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).drop("_copy")


def op1_token_counts(spark: SparkSession, sf_dir: str, limit: int = 2048) -> DataFrame:
    counts = count_tokens(table(spark, sf_dir, "documents"))
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
