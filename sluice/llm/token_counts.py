"""Token counts with a whole-token shortcut for a word-prefix BPE vocabulary.

The vocabulary is examined once on the driver. If no piece has the space mark after
another character, no merge can cross from a character into a following space mark,
so a text splits exactly into pre-tokens (a run of space marks and what follows it).
A pre-token whose string is proved to encode alone as one piece counts 1 by lookup;
the library merges only the remaining ones, each distinct one once per worker cache.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: pre-tokens a worker remembers before it starts anew (bounds its memory).
CACHE = 300_000
_PRE = re.compile(" *[^ ]+| +$")


def prove_whole_tokens(model: bytes) -> frozenset[str]:
    """Strings s such that `` s`` (one space mark before it) is proved to be one token.

    Raises ValueError where the splitting argument does not hold for the vocabulary.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
        raise ValueError("a piece joins a character to a following space mark")
    if len(sp.encode("a  a ")) != len(sp.encode("a")) + len(sp.encode(" a")) + len(sp.encode("")) + 1:
        raise ValueError("the model drops or adds white space")
    words = [p[1:] for p in pieces if len(p) > 1 and p[0] == MARK and MARK not in p[1:]]
    ids = sp.encode(words, num_threads=1)
    return frozenset(w for w, got in zip(words, ids) if len(got) == 1 and sp.id_to_piece(got[0]) == MARK + w)


class _Counts(dict):
    """tokens of a pre-token given without its one leading space mark."""

    def __init__(self, model: bytes, whole: frozenset[str]):
        import sentencepiece

        super().__init__(dict.fromkeys(whole, 1))
        self.sp, self.whole = sentencepiece.SentencePieceProcessor(model_proto=model), whole

    def __missing__(self, pre: str) -> int:
        if len(self) > CACHE + len(self.whole):
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
        n = len(self.sp.encode(pre, num_threads=1))
        if len(pre) <= 64:
            self[pre] = n
        return n

    def of(self, text: str | None) -> int:
        if not text:
            return 0
        if MARK in text:
            text = text.replace(MARK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            # the dummy prefix is one more leading space mark; each pre-token drops one
            return sum(map(self.__getitem__, (p[1:] for p in _PRE.findall(" " + text) if p != " "))) + (
                1 if text[-1] == " " and text[-2:] != "  " and text != " " else 0
            )
        return sum(map(self.__getitem__, text.split(" ")))


_LOADED: dict[str, _Counts] = {}


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc id, n_bytes, n_tokens, over_limit for every row.

    Null and empty texts have 0 bytes and 0 tokens; null ids pass through; repeated
    rows are repeated; other columns are ignored. Whole texts, any length. Narrow:
    no shuffle, the broadcast is the vocabulary file (a fixed size).
    """
    with open(model_path, "rb") as f:
        model = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((model, prove_whole_tokens(model)))
    key = hashlib.sha1(model).hexdigest()

    def run(batches):
        if key not in _LOADED:
            _LOADED.clear()
            _LOADED[key] = _Counts(*shared.value)
        counts = _LOADED[key]
        for b in batches:
            texts = b.column(1).to_pylist()
            n = [counts.of(t) for t in texts]
            size = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["id", "n_bytes", "n_tokens", "over_limit"],
            )

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    out = src.mapInArrow(run, "id long, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
