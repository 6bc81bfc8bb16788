"""Token counts by heap-and-linked-list byte-pair merging.

The vocabulary is that of a public sentencepiece BPE model with byte fallback.
No identifiers are made: a text's count is its initial symbols (a character of
the vocabulary is one, any other its UTF-8 bytes) less the merges that were done.

A blank opens a piece and never stands inside one unless only blanks precede
it (this is checked against the vocabulary), so a text falls into units that no
merge can cross: a run of blanks with the other characters after it. Counts of
units are remembered in each Python worker, up to a bound; texts with long
units need no more than O(n log n), which the heap gives.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .common import kept

#: The model's mark for a blank.
BLANK = "▁"
#: A run of blanks with what follows it, or the blanks at the end.
UNIT = re.compile(" *[^ ]+| +")
#: Units whose counts a worker remembers before it starts afresh.
REMEMBERED = 1_000_000
#: Characters of the longest unit that is remembered.
LONGEST_REMEMBERED = 64


class Merges:
    """Ranks of the pieces of a sentencepiece BPE model."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rules = model.normalizer_spec
        if (rules.precompiled_charsmap, rules.add_dummy_prefix, rules.remove_extra_whitespaces, rules.escape_whitespaces) != (b"", True, False, True):
            raise ValueError("only models that take texts as they are, with a blank in front, are counted here")
        if model.trainer_spec.model_type != proto.TrainerSpec.BPE or not model.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback is wanted")
        normal = [p for p in model.pieces if p.type == proto.ModelProto.SentencePiece.NORMAL]
        if any(p.type == proto.ModelProto.SentencePiece.USER_DEFINED for p in model.pieces):
            raise ValueError("pieces defined by a user aren't merged and can't be counted here")
        if any(BLANK in p.piece.lstrip(BLANK) for p in normal):
            raise ValueError("a piece crosses a blank")
        self.rank = {p.piece.replace(BLANK, " "): -p.score for p in normal}

    def count(self, unit: str) -> int:
        """Tokens of one unit: initial symbols less merges."""
        rank, n = self.rank, len(unit)
        total = sum(1 if c in rank else len(c.encode()) for c in unit)
        if n == 1:
            return total
        get = rank.get
        # Links to the neighbours; a symbol is the slice from its start to its end.
        ahead, behind = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(unit[i : i + 2])) is not None]
        heapify(heap)
        merges = 0
        while heap:
            _, left, end = heappop(heap)
            if not alive[left]:
                continue
            right = ahead[left]
            if right >= n or ahead[right] != end:  # one of the two has grown since
                continue
            merges += 1
            alive[right] = False
            ahead[left] = end
            if end < n:
                behind[end] = left
                after = ahead[end]
                if (r := get(unit[left:after])) is not None:
                    heappush(heap, (r, left, after))
            if (before := behind[left]) >= 0 and (r := get(unit[before:end])) is not None:
                heappush(heap, (r, before, end))
        return total - merges


class Counts(dict):
    """Counts of units, each made when first asked for; a unit's key leaves out its first blank."""

    def __init__(self, merges: Merges) -> None:
        super().__init__()
        self.merges = merges

    def __missing__(self, key: str) -> int:
        found = self.merges.count(" " + key)
        if len(key) < LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[key] = found
        return found

    def of(self, text: str) -> int:
        """Tokens of a whole text, which gets a blank in front unless it is empty."""
        if not text:
            return 0
        text = text.replace(BLANK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            keys = [unit[1:] for unit in UNIT.findall(" " + text)]
        else:
            keys = text.split(" ")
        return sum(map(self.__getitem__, keys))


def counts_of(path: str) -> Counts:
    """The counts of a model, kept as long as the worker lives and does nothing else."""
    return kept(f"token counts {path}", lambda: Counts(Merges(path)))


def token_counts(frame: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text", limit: int = 4096) -> DataFrame:
    """Tokens of every whole text.

    Returns ``id_column``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``
    (more than ``limit`` tokens). A null text counts as empty and has no bytes
    and no tokens; null and repeated ids are kept, a row for each row; other
    columns are left aside; an empty table gives none. ``model_path`` must
    exist on every machine. No row leaves its partition.
    """
    kind = frame.schema[id_column].dataType

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counts_of(model_path).of
        for batch in batches:
            texts = batch.column(1)
            tokens = pa.array([of(text.as_py() or "") for text in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), tokens], ["id", "n_bytes", "n_tokens"])

    text = F.col(text_column).cast("string")
    plain = frame.select(F.col(id_column).alias("id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    out = plain.mapInArrow(counted, StructType().add("id", kind).add("n_bytes", LongType()).add("n_tokens", LongType()))
    return out.select(F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
