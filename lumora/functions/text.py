"""Text for the encoder: Unicode normalisation, and the word-piece tokeniser of the text model."""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumora.functions.scalar import collapse_space


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Spark has no normalisation of its own."""
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def normalized(text: Column) -> Column:
    """NFC, lower case, single blanks: how queries reach the text encoder. ASCII needs no NFC and skips Python's work."""
    return collapse_space(F.lower(F.when(text.rlike(r"^\p{ASCII}*$"), text).otherwise(nfc(text))))


@F.pandas_udf(T.StringType())
def name_uuid(name: pd.Series) -> pd.Series:
    """UUIDv5 of a name in the DNS namespace: the stable id of a known person."""
    return name.map(lambda n: str(uuid.uuid5(uuid.NAMESPACE_DNS, n)), na_action="ignore")


class WordPieces:
    """Byte-pair merges over characters, with an end-of-word mark, as the text model was trained with.

    ranks: pair of symbols to rank. vocabulary: token to id. Symbols inside a word but the last end in the joiner '@@'.
    """

    END, JOINER = "</w>", "@@"
    # The special tokens and their ids.
    SPECIAL = {"<s>": 0, "<pad>": 1, "</s>": 2, "<unk>": 3}

    def __init__(self, ranks: dict[tuple[str, str], int], vocabulary: dict[str, int]):
        self.ranks, self.vocabulary = ranks, {**self.SPECIAL, **vocabulary}
        self.known: dict[str, list[str]] = {}

    def word(self, word: str) -> list[str]:
        """A word's pieces. A word of one character is taken as it is."""
        if word in self.known:
            return self.known[word]
        parts = [*word[:-1], word[-1:] + self.END]
        while len(parts) > 1:
            rank, pair = min((self.ranks.get(p, float("inf")), k, p) for k, p in enumerate(zip(parts, parts[1:], strict=False)))[::2]
            if rank == float("inf"):
                break
            merged, free = [], False
            for part in parts:
                # What has just been merged can't be a pair's first half in the same pass.
                free = not (free and (merged[-1], part) == pair)
                if free:
                    merged.append(part)
                else:
                    merged[-1] += part
            parts = merged
        out = [p + self.JOINER for p in parts[:-1]] + [parts[-1].removesuffix(self.END)]
        if len(self.known) < 100_000:
            self.known[word] = out
        return out

    def tokens(self, text: str) -> list[str]:
        return [p for w in re.findall(r"\S+", text) for p in " ".join(self.word(w)).split()]

    def ids(self, tokens: list[str]) -> list[int]:
        return [self.vocabulary.get(t, self.SPECIAL["<unk>"]) for t in tokens]

    def with_specials(self, first: list[int], second: list[int] | None = None) -> list[int]:
        begin, end = self.SPECIAL["<s>"], self.SPECIAL["</s>"]
        return [begin, *first, end] if second is None else [begin, *first, end, end, *second, end, end]

    def encoded(self, text: str, length: int = 64) -> tuple[list[int], list[int]]:
        """Ids and mask of a fixed length. Cutting may take the end token away, as it does in the model's own input."""
        ids = self.with_specials(self.ids(self.tokens(text)))[:length]
        return ids + [self.SPECIAL["<pad>"]] * (length - len(ids)), [1] * len(ids) + [0] * (length - len(ids))


def load_vocabulary(lines: list[str]) -> dict[str, int]:
    """The token is what stands before the last blank; the first of equal tokens counts; ids go on after the specials."""
    out: dict[str, int] = {}
    for line in lines:
        token = line.strip().rpartition(" ")[0] or line.strip()
        if token and token not in out and token not in WordPieces.SPECIAL:
            out[token] = len(WordPieces.SPECIAL) + len(out)
    return out


def load_merges(lines: list[str]) -> dict[tuple[str, str], int]:
    """The first two fields; the rank is the line's number, blank lines included."""
    out: dict[tuple[str, str], int] = {}
    for rank, line in enumerate(lines):
        fields = line.split()
        if len(fields) >= 2:
            out[fields[0], fields[1]] = rank
    return out


def encode_column(text: Column, pieces: WordPieces, length: int = 64) -> Column:
    """struct<ids, mask> of a text column; the vocabulary goes along once for each task."""

    @F.pandas_udf("struct<ids:array<int>,mask:array<int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [pieces.encoded(t or "", length) for t in batch]
            yield pd.DataFrame({"ids": [r[0] for r in rows], "mask": [r[1] for r in rows]})

    return run(text)


def register(spark: SparkSession) -> None:
    """The functions that SQL users need by name."""
    spark.udf.register("nfc", nfc)
    spark.udf.register("name_uuid", name_uuid)
