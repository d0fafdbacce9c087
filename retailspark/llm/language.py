"""Language by segmentation-marginalised unigrams.

Each language has probabilities for the pieces of one fixed public vocabulary.
A word's probability is the sum over all its segmentations into pieces, by the
forward algorithm; a text's is the product over its words.  The probabilities are
estimated by expectation-maximisation, which weighs all segmentations too.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from retailspark.llm.common import bounded_batches, materialize, whole, with_scores
from retailspark.llm.probminhash import mix

cloudpickle.register_pickle_by_value(sys.modules[__name__])

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Documents of each language that are learned from, the first by hash of the id,
#: and their words, the most frequent ones.
TRAIN_DOCS, TRAIN_WORDS = 400, 30_000
ROUNDS = 4
#: Words of fewer bytes are scored together; a longer one goes byte by byte, ``PART``
#: at a time, whatever its length.  For learning it is cut between characters.
WORD, PART = 32, 4_096
#: What a piece has beyond its expected count.
SMOOTH = 0.02
UNDEFINED = "und"
#: Bytes of text, and words, that are scored at once.
AT_ONCE, WORDS_AT_ONCE = 8_000_000, 4_096
START = 1  # the byte that stands for the start of a word
_ROLL = np.uint64(0x9E3779B97F4A7C15)


def load_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Pieces of a SentencePiece model, a word's start as the byte ``START``,
    and all single bytes.  Words hold no blanks, so pieces with a blank inside don't
    count.  Read on the driver only; the model carries them along."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    known = {p.replace("▁", chr(START)).encode() for p in pieces}
    return sorted({bytes([b]) for b in range(256)} | {p for p in known if START not in p[1:]})


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    hashes: np.ndarray  # of the pieces, ascending
    first: np.ndarray  # by the top 16 bits of a hash: where those start
    probability: np.ndarray  # (pieces + 1) x languages, in the order of hashes; the last row is no piece
    lengths: tuple[int, ...]  # of the pieces, in bytes

    def log_probability(self, words: np.ndarray, size: np.ndarray) -> np.ndarray:
        """(words x languages) for a matrix of padded words."""
        return np.log(_forward(words, size, _arcs(words, size, self.hashes, self.first, self.lengths), self.probability)[np.arange(len(words)), size])

    def log_of_long(self, word: bytes) -> np.ndarray:
        """The same for one word of any length: the ways to the last bytes are carried
        on, and scaled before they get too small for a number."""
        line = np.frombuffer(bytes([START]) + word, dtype=np.uint8)
        far = max(self.lengths)
        ways, log = np.zeros((far, len(self.languages))), np.zeros(len(self.languages))
        ways[0] = 1
        for at in range(0, len(line), PART):
            base, end = max(0, at - far), min(len(line), at + PART)
            arcs = _arcs(line[None, base:end], np.array([end - base]), self.hashes, self.first, self.lengths)
            into = np.full((end - at, far), -1, dtype=np.int32)  # the piece of k + 1 bytes that ends here
            for k, found in arcs.items():
                ends = np.arange(max(at + 1, k + base), end + 1)
                into[ends - at - 1, k - 1] = found[0, ends - k - base]
            arriving = self.probability[into]
            for i in range(len(arriving)):
                now = (ways * arriving[i]).sum(axis=0)
                ways[1:] = ways[:-1].copy()
                ways[0] = now
                if i % 8 == 7:
                    most = ways.max(axis=0)
                    ways /= most
                    log += np.log(most)
        return log + np.log(ways[0])

    def score(self, texts: list[bytes]) -> np.ndarray:
        """(texts x languages) log probabilities of whole texts."""
        out = np.zeros((len(texts), len(self.languages)))
        start, size, owner = words_in(texts)
        line = b"\n".join(texts) + b"\n" + b"\0" * WORD
        raw, long, known = np.frombuffer(line, dtype=np.uint8), size >= WORD, {}
        for s, n, text in zip(start[long].tolist(), size[long].tolist(), owner[long].tolist(), strict=True):
            word = line[s : s + n]
            if word not in known:
                known[word] = self.log_of_long(word)
            out[text] += known[word]
        start, size, owner = start[~long], size[~long], owner[~long]
        key = _word_keys(raw, start, size)
        _, once, which = np.unique(key, return_index=True, return_inverse=True)
        order = np.argsort(size[once], kind="stable")
        logs = np.empty((len(once), len(self.languages)))
        for at in range(0, len(order), WORDS_AT_ONCE):
            rows = order[at : at + WORDS_AT_ONCE]
            words, n = matrix(raw, start[once[rows]], size[once[rows]])
            logs[rows] = self.log_probability(words, n)
        for k in range(out.shape[1]):
            out[:, k] += np.bincount(owner, weights=logs[which, k], minlength=len(texts))
        return out


def words_in(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and text of each word in ``b"\\n".join(texts)``: runs of ASCII
    letters and bytes from 128 on."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    letter = ((raw >= 97) & (raw <= 122)) | ((raw >= 65) & (raw <= 90)) | (raw >= 128)
    edge = np.flatnonzero(np.diff(letter.astype(np.int8), prepend=0, append=0))
    start, end = edge[0::2], edge[1::2]
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, side="right")
    return start, end - start, owner


def matrix(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words as rows, each after ``START`` and padded with 0, and their lengths with it."""
    width = int(size.max()) if len(size) else 0
    body = raw[start[:, None] + np.arange(width)]
    body = np.where(np.arange(width) < size[:, None], body, 0)
    return np.concatenate([np.full((len(body), 1), START, dtype=np.uint8), body], axis=1), size + 1


def _word_keys(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    key = size.astype(np.uint64)
    for k in range(WORD - 1):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        key[more] = key[more] * _ROLL + raw[start[more] + k]
    return mix(key)


def hash_pieces(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending hashes, where each value of their top 16 bits starts, and the order of the pieces."""
    h = np.zeros(len(pieces), dtype=np.uint64)
    size = np.array([len(p) for p in pieces])
    padded = np.zeros((len(pieces), size.max()), dtype=np.uint64)
    for i, p in enumerate(pieces):
        padded[i, : len(p)] = np.frombuffer(p, dtype=np.uint8)
    for k in range(size.max()):
        h = np.where(size > k, h * _ROLL + padded[:, k] + np.uint64(1), h)
    h = mix(h)
    order = np.argsort(h)
    if len(np.unique(h)) != len(h):
        raise ValueError("two pieces have one hash")
    return h[order], np.searchsorted(h[order] >> np.uint64(48), np.arange(1 << 16).astype(np.uint64)), order


def _arcs(words: np.ndarray, size: np.ndarray, hashes: np.ndarray, first: np.ndarray, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """By length, the piece (its place among the hashes, or -1) from each byte on."""
    n, width = words.shape
    rolled = np.zeros((n, width + 1), dtype=np.uint64)
    for i in range(width):
        rolled[:, i + 1] = rolled[:, i] * _ROLL + words[:, i] + np.uint64(1)
    out = {}
    for k in (n for n in lengths if n <= width):
        power = np.uint64(pow(int(_ROLL), k, 1 << 64))
        h = mix(rolled[:, k:] - rolled[:, :-k] * power)
        at = first[(h >> np.uint64(48)).astype(np.int64)]
        found = np.full(h.shape, -1, dtype=np.int32)
        for _ in range(8):  # few hashes share their top 16 bits
            open_ = np.minimum(at, len(hashes) - 1)
            found = np.where(hashes[open_] == h, open_, found)
            at = at + 1
            if _ >= 3 and not ((hashes[np.minimum(at, len(hashes) - 1)] >> np.uint64(48)) == (h >> np.uint64(48))).any():
                break
        found[np.arange(h.shape[1]) + k > size[:, None]] = -1
        out[k] = found
    return out


def _forward(words: np.ndarray, size: np.ndarray, arcs: dict[int, np.ndarray], probability: np.ndarray) -> np.ndarray:
    """(words x (bytes + 1) x languages): the probability of all ways to each byte."""
    n, width = words.shape
    ways = np.zeros((n, width + 1, probability.shape[1]))
    ways[:, 0] = 1
    for end in range(1, width + 1):
        for k, found in arcs.items():
            if k <= end:
                ways[:, end] += ways[:, end - k] * probability[found[:, end - k]]
    return ways


def _expected(words: np.ndarray, size: np.ndarray, counts: np.ndarray, hashes: np.ndarray, first: np.ndarray, lengths: tuple[int, ...], probability: np.ndarray, into: np.ndarray) -> None:
    """Adds the expected counts of pieces in words with ``counts`` (words x languages)."""
    arcs = _arcs(words, size, hashes, first, lengths)
    ways = _forward(words, size, arcs, probability)
    n, width = words.shape
    rest = np.zeros_like(ways)
    rest[np.arange(n), size] = 1
    for start in range(width - 1, -1, -1):
        for k, found in arcs.items():
            if k <= width - start:
                rest[:, start] += probability[found[:, start]] * rest[:, start + k]
    per = counts / np.maximum(rest[:, 0], 1e-300)
    for k, found in arcs.items():
        for start in range(width - k + 1):
            piece = found[:, start]
            rows = np.flatnonzero(piece >= 0)
            share = ways[rows, start] * probability[piece[rows]] * rest[rows, start + k] * per[rows]
            for x in range(into.shape[1]):
                into[:, x] += np.bincount(piece[rows], weights=share[:, x], minlength=len(into))


def estimate(pieces: list[bytes], languages: list[str], counts: list[tuple[bytes, int, int]], rounds: int = ROUNDS) -> LanguageModel:
    """Expectation-maximisation from (word, language number, count) rows."""
    hashes, first, _ = hash_pieces(pieces)
    lengths = tuple(sorted({len(p) for p in pieces}))
    k = max(len(languages), 1)
    types = sorted({w for w, _, _ in counts}, key=lambda w: (len(w), w))
    place = {w: i for i, w in enumerate(types)}
    seen = np.zeros((len(types), k))
    for w, language, n in counts:
        seen[place[w], language] += n
    raw = np.frombuffer(b"".join(types) + b"\0" * WORD, dtype=np.uint8)
    size = np.array([len(w) for w in types], dtype=np.int64)
    start = np.cumsum(size) - size
    probability = np.full((len(pieces) + 1, k), 1.0 / len(pieces))
    probability[-1] = 0
    for _ in range(rounds if types else 0):
        total = np.full((len(pieces), k), SMOOTH)
        for at in range(0, len(types), WORDS_AT_ONCE):
            words, n = matrix(raw, start[at : at + WORDS_AT_ONCE], size[at : at + WORDS_AT_ONCE])
            _expected(words, n, seen[at : at + WORDS_AT_ONCE], hashes, first, lengths, probability, total)
        probability[:-1] = total / total.sum(axis=0)
    return LanguageModel(languages, hashes, first, probability, lengths)


def _lower(texts: list[str]) -> list[bytes]:
    return [t.lower().encode("utf-8", "replace") for t in texts]


def _short(word: bytes) -> list[bytes]:
    """A word for learning: cut between characters where it has ``WORD`` bytes or more."""
    out = []
    while len(word) >= WORD:
        at = WORD - 1
        while at > WORD - 5 and 0x80 <= word[at] < 0xC0:
            at -= 1
        out.append(word[:at])
        word = word[at:]
    return [*out, word]


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for language, part in batch.groupby("lang"):
            texts = _lower(part["text"].tolist())
            raw = b"\n".join(texts) + b"\n"
            start, size, _ = words_in(texts)
            counted: dict[bytes, int] = {}
            for s, n in zip(start.tolist(), size.tolist(), strict=True):
                for w in _short(raw[s : s + n]):
                    counted[w] = counted.get(w, 0) + 1
            yield pd.DataFrame({"lang": language, "word": list(counted), "n": list(counted.values())})


def _small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Hinted for broadcast if it has no more rows than that."""
    return F.broadcast(df) if df.count() <= most else df


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocabulary: str = VOCABULARY) -> LanguageModel:
    """Learns from at most ``TRAIN_DOCS`` whole documents of each language, the
    first by hash of the id.  Null languages and ids aren't read; without any
    document there is no language."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("id is not null and lang is not null and text is not null")
    # Of a language with n documents those with a hash below 8 * TRAIN_DOCS / n hold
    # the first TRAIN_DOCS by hash (but for a chance far below 1e-100), so a very
    # common language sends no more rows to the ranking than a rare one.
    hashed = rows.select("id", "lang", (F.pmod(F.xxhash64("id"), F.lit(1 << 53)) / float(1 << 53)).alias("_hash"))
    share = materialize(hashed.groupBy(F.col("lang").alias("_of")).agg((8.0 * TRAIN_DOCS / F.count(F.lit(1))).alias("_share")), "language-shares")
    near = hashed.join(_small(share), F.col("lang") == F.col("_of")).where(F.col("_hash") < F.col("_share"))
    by_hash = Window.partitionBy("lang").orderBy("_hash", "id")
    ranked = near.withColumn("_rank", F.row_number().over(by_hash)).where(F.col("_rank") <= TRAIN_DOCS)
    chosen = materialize(ranked.select(F.col("id").alias("_id"), F.col("lang").alias("_lang")), "language-sample")
    languages = [r["_lang"] for r in chosen.select("_lang").distinct().orderBy("_lang").collect()]
    sample = rows.join(_small(chosen), (F.col("id") == F.col("_id")) & (F.col("lang") == F.col("_lang"))).select("lang", "text")
    counts = bounded_batches(sample).mapInPandas(_words, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    often = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    kept = counts.withColumn("_rank", F.row_number().over(often)).where(F.col("_rank") <= TRAIN_WORDS).select("lang", "word", "n").collect()
    number = {x: i for i, x in enumerate(languages)}
    return estimate(load_vocabulary(vocabulary), languages, [(bytes(r["word"]), number[r["lang"]], r["n"]) for r in kept])


def predict(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of ``docs`` and those named by ``out``: the language and its
    probability given the whole text, all languages being as likely before.  A column
    of ``docs`` that has such a name is replaced.

    ``und`` with a score of 0 for null, for a text without a letter, and if no
    language was learned; of languages as likely as each other the first by code
    point.  Every row is judged by itself: repeats agree, and an empty table
    stays empty."""

    def judge(texts: list[str], has_letter: list[bool]) -> list[np.ndarray]:
        if not model.languages:
            return [np.full(len(texts), UNDEFINED, dtype=object), np.zeros(len(texts))]
        raw, parts, at, size = _lower(texts), [], 0, 0
        for i, t in enumerate(raw):
            size += len(t)
            if size > AT_ONCE or i == len(raw) - 1:
                parts.append(model.score(raw[at : i + 1]))
                at, size = i + 1, 0
        logs, known = np.concatenate(parts), np.array(has_letter)
        named = np.array(model.languages, dtype=object)[logs.argmax(axis=1)]
        share = 1 / np.exp(np.clip(logs - logs.max(axis=1, keepdims=True), -700, 0)).sum(axis=1)
        return [np.where(known, named, UNDEFINED), np.where(known, share, 0.0)]

    has_letter = F.regexp_like(whole(F.col(text_col)), F.lit(r"\p{L}"))
    return with_scores(docs, text_col, judge, [StructField(out[0], StringType()), StructField(out[1], DoubleType())], also=has_letter)
