"""Token counts of sections from one encoding of the whole document.

Encoding sections one by one gives other counts than encoding the document, because tokens may reach over a boundary.
Here the whole text is encoded once with character spans, and the spans meet the sections of the same document in an
interval join (both sides sorted, one binary search per token).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shorepix.llm.tokens import chunks, default_tokenizer, encoder

SCHEMA = "doc_id long, section int, name string, start int, end int, n_tokens long, n_shared long, share double"
FIELDS = [field.split()[0] for field in SCHEMA.split(", ")]


def joined_fields(df: DataFrame, fields: list[str], separator: str = "\n") -> DataFrame:
    """Add ``text`` (the fields in order, null as empty, with ``separator`` between) and ``sections``, one per field."""
    values = [F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")) for name in fields]
    at, parts = F.lit(0), []
    for name, value in zip(fields, values, strict=True):
        parts.append(F.struct(F.lit(name).alias("name"), at.cast("int").alias("start"), (at + F.length(value)).cast("int").alias("end")))
        at = at + F.length(value) + len(separator)
    return df.withColumns({"text": F.concat_ws(separator, *values), "sections": F.array(*parts)})


def line_bounds(text: str, longest: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the lines, without their line feeds; an empty text is one empty line. Lines of more than
    ``longest`` characters are cut into pieces of that many, the last one shorter."""
    feeds = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") == 10)
    start, end = np.append(0, feeds + 1), np.append(feeds, len(text))
    if longest is None:
        return start, end
    pieces = np.maximum(1, -(-(end - start) // longest))
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(start, pieces) + nth * longest
    return start, np.minimum(np.repeat(end, pieces), start + longest)


def attribute(spans: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, tokens that also touch another section, fractional tokens) of each section; sections are sorted and do
    not overlap. The last entry of each stands for text outside all sections.

    Rule: a token belongs to the section that holds most of its characters, the earlier one on a tie; text outside the
    sections counts as a section of its own that loses ties. A token without characters counts at its position. The
    fractional count splits a token by characters.
    """
    outside = len(start)
    tokens, shared, share = np.zeros(outside + 1, np.int64), np.zeros(outside + 1, np.int64), np.zeros(outside + 1)
    low = spans[:, 0]
    high = np.maximum(spans[:, 1], low + 1)
    first = np.searchsorted(end, low, "right")  # the first section that ends after the token's first character
    whole = (first < outside) & (start[np.minimum(first, outside - 1)] <= low) & (high <= end[np.minimum(first, outside - 1)]) if outside else np.zeros(len(low), bool)
    tokens += np.bincount(first[whole], minlength=outside + 1)
    share += tokens
    for k in np.flatnonzero(~whole):
        a, b, s, parts = int(low[k]), int(high[k]), int(first[k]), []
        while s < outside and start[s] < b:
            if (held := min(b, int(end[s])) - max(a, int(start[s]))) > 0:
                parts.append((s, held))
            s += 1
        if (free := b - a - sum(held for _, held in parts)) > 0:
            parts.append((outside, free))
        owner = max(parts, key=lambda part: (part[1], -part[0]))[0]
        tokens[owner] += 1
        shared[owner] += len(parts) > 1
        for s, held in parts:
            share[s] += held / (b - a)
    return tokens, shared, share


def section_token_counts(documents: DataFrame, sections: str | None = None, tokenizer: str | None = None,
                         by_word: bool = True, longest: int | None = None) -> DataFrame:
    """One row per section of each document: doc_id, section (from 0), name, start, end (characters), n_tokens,
    n_shared (tokens of these that reach into another section), share (fractional tokens).

    ``sections`` names a column array<struct<name, start, end>>; without it the lines of ``text`` are the sections (name
    null), longer ones cut after every ``longest`` characters, also inside words. Sections are sorted by start; where they overlap, the later one starts at the end of the earlier. Tokens outside
    all sections make a row with section -1 (only if there are any). Null texts count as empty; a null list of sections
    counts as none. Repeated rows give repeated sections; other columns are ignored.
    """
    tokenizer = tokenizer or default_tokenizer()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, by_word, True)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for at, texts in chunks(batch.column(1).to_pylist()):
                given = batch.column(2).slice(at, len(texts)).to_pylist() if sections else None
                _, counts, spans = coder.chunk(texts)
                ends = np.cumsum(counts)
                out = [[] for _ in FIELDS]
                for k, text in enumerate(texts):
                    names = None
                    if sections:
                        found = sorted(((x["start"], x["end"], x["name"]) for x in given[k] or [] if x), key=lambda x: x[:2])
                        names = [x[2] for x in found]
                        start = np.array([x[0] for x in found], np.int64)
                        end = np.maximum.accumulate(np.array([x[1] for x in found], np.int64)) if found else start
                        start = np.maximum(start, np.append(-1, end)[:len(start)])
                        end = np.maximum(start, end)
                    else:
                        start, end = line_bounds(text, longest)
                    tokens, shared, share = attribute(spans[ends[k] - counts[k]:ends[k] - 1], start, end)
                    n = len(start) + bool(share[-1] > 0)
                    order = [*range(len(start)), -1][:n]
                    rows = ([doc_ids[at + k]] * n, order, [names[i] if names and i >= 0 else None for i in order],
                            [int(start[i]) if i >= 0 else None for i in order], [int(end[i]) if i >= 0 else None for i in order],
                            tokens[:n].tolist(), shared[:n].tolist(), share[:n].tolist())
                    for column, values in zip(out, rows, strict=True):
                        column += values
                kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=FIELDS)

    columns = [F.col("doc_id").cast("long"), F.col("text").cast("string")] + ([F.col(f"`{sections}`")] if sections else [])
    return documents.select(*columns).mapInArrow(count, SCHEMA)
