"""Token counts by section: whole texts are encoded once, token spans meet section spans.

Sections partition the text, so the spans of both sides are sorted and the interval join is
a merge inside the task that encoded the text; tokens never travel. A token that crosses a
boundary goes to one section by an explicit rule.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A public byte-level vocabulary, as ranks; the same path on every node.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the split pattern that belongs to that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Fixed value: the characters that the pattern's ``\\s`` stands for, many of them in a row.
LONG_BLANK = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")

#: A section ends after each line feed.
SECTION_END = rb"\n"

#: ``first``: where its first character is; ``most``: where most of its characters are, the
#: first of them if equal.
RULES = ("first", "most")

ROW_BUFFER = 50_000


def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    widths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        widths[rank] = len(token)
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return own, widths


def encoded(encoder, text: str) -> list[int]:
    """The tokens of a text, with no search over very long blank runs.

    The pattern takes a run of blanks but for its last one, which it leaves to what follows;
    at the end of the text it takes the whole run. Its search keeps a state per blank, so long
    runs are cut out by that rule and encoded as the one piece they are.
    """
    out: list[int] = []
    done = 0
    for run in LONG_BLANK.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        out += encoder.encode_ordinary(text[done : run.start()])
        out += encoder._encode_single_piece(text[run.start() : end])
        done = end
    return out + encoder.encode_ordinary(text[done:])


def attributed(
    ends: np.ndarray, stops: np.ndarray, raw: np.ndarray, rule: str
) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and boundary-crossing tokens of each section.

    ``ends`` and ``stops`` are the exclusive byte ends of tokens and of sections, ``raw`` the
    bytes, by which characters are told apart: a byte that continues one counts for none.
    """
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    first = np.searchsorted(stops, starts, side="right")
    last = np.searchsorted(stops, ends - 1, side="right")
    crossing = np.flatnonzero(first != last)
    place = first.copy()
    if rule == "most":
        chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        for t in crossing.tolist():
            inner = stops[first[t] : last[t]]
            cuts = np.concatenate(([starts[t]], inner, [ends[t]]))
            place[t] = first[t] + int(np.argmax(np.diff(chars[cuts])))
    n = len(stops)
    return np.bincount(place, minlength=n), np.bincount(place[crossing], minlength=n)


def _counter(path: str, rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, widths = _encoder(path)
        names = ["key", "section", "start", "end", "n_tokens", "n_crossing"]
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            keys = pa.array([k for k, c in held for _ in range(len(c[0]))], kind)
            columns = [np.concatenate([c[i] for _, c in held]) for i in range(5)]
            return pa.RecordBatch.from_arrays([keys, *(pa.array(c, pa.int64()) for c in columns)], names=names)

        rows, kind = 0, pa.int64()
        for batch in batches:
            kind = batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = (text or "").encode()
                raw = np.frombuffer(data, np.uint8)
                stops = np.array([m.end() for m in re.finditer(SECTION_END, data)], np.int64)
                if not len(stops) or stops[-1] < len(data):
                    stops = np.append(stops, len(data))
                ids = np.array(encoded(encoder, text or ""), np.int64)
                tokens, crossing = attributed(np.cumsum(widths[ids]), stops, raw, rule)
                chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[stops]
                begins = np.concatenate(([0], chars[:-1]))
                held.append((key, (np.arange(len(stops)), begins, chars, tokens, crossing)))
                rows += len(stops)
                if rows >= ROW_BUFFER:
                    yield out()
                    held.clear()
                    rows = 0
        if held:
            yield out()

    return run


def count_sections(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", rule: str = "first", path: str = VOCABULARY
) -> DataFrame:
    """One row per section: key, section, start, end (code points), n_tokens, n_crossing.

    ``n_crossing`` of the tokens reach into another section. The tokens of a document sum to
    those of its whole text. A null or empty text has one empty section without tokens;
    repeated rows stay repeated; an empty table gives an empty result.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    plain = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kinds = f"key {plain.schema['key'].dataType.simpleString()}, section long, start long, end long, n_tokens long, n_crossing long"
    return plain.mapInArrow(_counter(path, rule), kinds).withColumnRenamed("key", key)
