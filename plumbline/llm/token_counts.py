"""Token counts of whole texts as a SentencePiece BPE model gives them.

Whole-token shortcut.  A text's pre-tokens are runs of spaces with the characters up to
the next space.  No merge joins two pre-tokens if no piece has a word mark behind another
character; this is checked.  Before the job, every vocabulary string that can be a whole
pre-token is encoded once: where the result is one token, that is proof for good.  In the
texts, proven pre-tokens count 1 by a look-up; only the rest is merged by the library, and
each different one once per task slice.

The shortcut needs a normaliser that leaves texts as they are.  ``proven_tokens`` checks
that too; a model of another kind is then used without a shortcut, with the same counts.

A null text counts as empty (0 tokens).  Empty tables give no rows, repeated rows are
counted each, other columns are ignored.  Rows are independent: there is no shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

OVER = 4096
MARK = "▁"
_PROBES = ("a", " a", "a  b", "\t", "a\n b", " ", "Ａ", "é", "①", "\x00", "A‍b", "a b ")
_KEPT_COUNTS = 500_000


@lru_cache(maxsize=2)
def _model(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


def proven_tokens(path: str) -> frozenset[str] | None:
    """Pre-tokens (one space and what follows) that are one token; None: no shortcut."""
    model = _model(path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    plain = [p for i, p in enumerate(pieces) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    if any(MARK in p.lstrip(MARK) for p in plain):
        return None
    if any(model.normalize(x) != (MARK + x.replace(" ", MARK)) for x in _PROBES):
        return None
    if any(model.is_unused(i) for i in range(len(pieces))):
        return None
    single = {p for p in plain if p.startswith(MARK) and p.count(MARK) == 1 and len(p) > 1}
    return frozenset(" " + p[1:] for p in single if len(model.encode(p[1:])) == 1)


def pre_tokens(text: str) -> list[str]:
    """Runs of spaces with what follows; the leading space that the model adds included."""
    out, spaces = [], 0
    parts = text.split(" ")
    for part in parts[:-1] if parts[-1] == "" else parts:
        spaces += 1
        if part:
            out.append(" " * spaces + part)
            spaces = 0
    if parts[-1] == "":
        spaces += 1
    if spaces:
        out.append(" " * spaces)
    return out


def count_tokens(texts: list[str], path: str, proven: frozenset[str] | None, known: dict[str, int]) -> list[int]:
    model, result = _model(path), []
    if proven is None:
        return [len(x) for x in model.encode(texts, num_threads=1)]
    known.setdefault(" ", len(model.encode("a ", num_threads=1)) - len(model.encode("a", num_threads=1)))
    for text in texts:
        total = 0
        if text:
            rest = Counter(pre_tokens(text.replace(MARK, " ")))
            for word, times in rest.items():
                if word in proven:
                    total += times
                    continue
                n = known.get(word)
                if n is None:
                    n = len(model.encode(word[1:], num_threads=1))
                    if len(known) < _KEPT_COUNTS and len(word) < 64:
                        known[word] = n
                total += n * times
        result.append(total)
    return result


def count(docs: DataFrame, model_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row."""
    proven = proven_tokens(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            texts = batch.column(1).cast(pa.large_string()).fill_null("")
            counts = []
            for at in range(0, len(texts), 256):
                counts += count_tokens(texts.slice(at, 256).to_pylist(), model_path, proven, known)
            counts = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.binary_length(texts.cast(pa.large_binary())).cast(pa.int64()), counts, pc.greater(counts, OVER)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.selectExpr(f"cast(`{key}` as bigint) as doc_id", f"`{text}` as text")
    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
