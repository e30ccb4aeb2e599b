"""Several values packed in one field: one row per value, its position kept.

The field is scanned as one Arrow string buffer per batch: quote parity and
delimiter masks are computed over all bytes at once, the masks give child
offsets, the offsets a list array, and the list array is flattened with the
ordinals of its parents.

Dialects are told apart row by row: a field in square brackets is a list
literal (items between commas, in quotes of either kind, backslash escapes);
any other field is cut at every delimiter outside double quotes.  A quoted
value keeps its delimiters and loses its quotes, doubled quotes inside become
one.  Names given as `protected` are never cut even if unquoted.

Defined results: a null, empty or blank field and an empty list give no row;
empty values do not count; equal values stay, each with its own position;
positions run from 1.  A quote that is opened but never closed, or one inside
an unquoted value, is an ordinary sign.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Delimiters of free-text values and, besides them, of codes (which hold no blanks).
VALUE_DELIMITERS = (";", ",", "|", "\t", "\n", "\r", "；", "，", "、", "•", " / ")
CODE_DELIMITERS = (*VALUE_DELIMITERS, " ", "/", "+")
BLANKS = b" \t\n\r\x0b\x0c"


def _runs(data: np.ndarray, needle: bytes) -> np.ndarray:
    """Mask of the positions where the bytes of needle begin."""
    n = len(needle)
    hit = data == needle[0]
    if n > 1:
        hit = hit.copy()
        for k in range(1, n):
            hit[:-k] &= data[k:] == needle[k]
            hit[len(hit) - k :] = False
    return hit


def _literal(text: str) -> list[str]:
    """Items of a bracketed list, read sign by sign: for the rows whose quotes parity can't settle."""
    body, out, cur, quote, k = text.strip()[1:-1], [], [], "", 0
    quoted = False
    while k < len(body):
        ch = body[k]
        if quote:
            if ch == "\\" and k + 1 < len(body):
                k += 1
                cur.append({"n": "\n", "t": "\t", "r": "\r"}.get(body[k], body[k]))
            elif ch == quote and re.match(r"\s*(,|$)", body[k + 1 :]):
                quote = ""
            else:
                cur.append(ch)
        elif ch in "\"'" and not "".join(cur).strip():
            quote, quoted, cur = ch, True, []
        elif ch == ",":
            out.append("".join(cur))
            cur, quoted = [], False
        elif not quoted or not ch.isspace():
            cur.append(ch)
        k += 1
    out.append("".join(cur))
    return [v for v in (x.strip() for x in out) if v]


def _irregular(text: str, cutter: re.Pattern, protected: re.Pattern | None) -> list[str]:
    """Values of a field with stray quotes: a quote opens at the start of a value only, and closes before a delimiter."""
    out, at, start = [], 0, 0
    spans = [m.span() for m in protected.finditer(text)] if protected else []
    while at <= len(text):
        if text[start:at].strip() == "" and at < len(text) and text[at] == '"':
            end = at + 1
            while (end := text.find('"', end)) >= 0:
                if text[end + 1 : end + 2] == '"':
                    end += 2
                    continue
                rest = text[end + 1 :]
                if not rest.strip() or cutter.match(rest) or cutter.match(rest.lstrip(" ")):
                    break
                end += 1
            if end >= 0:
                out.append(text[at + 1 : end].replace('""', '"'))
                nxt = cutter.search(text, end + 1)
                if not nxt:
                    return [v for v in (x.strip() for x in out) if v]
                at = start = nxt.end()
                continue
        inside = next((e for s, e in spans if s <= at < e), None)
        if inside:
            at = inside
            continue
        m = cutter.match(text, at) if at < len(text) else None
        if m or at == len(text):
            out.append(text[start:at])
            at = start = m.end() if m else at + 1
        else:
            at += 1
    return [v for v in (x.strip() for x in out) if v]


class Unpacker:
    """Compiled delimiters and protected names; `lists` turns a string array into a list array."""

    def __init__(self, delimiters: Sequence[str] = VALUE_DELIMITERS, protected: Sequence[str] = ()):
        self.delimiters = [d.encode() for d in delimiters]
        self.cutter = re.compile("|".join(re.escape(d) for d in sorted(delimiters, key=len, reverse=True)))
        torn = sorted({p.strip() for p in protected if p and self.cutter.search(p.strip())}, key=len, reverse=True)
        pattern = "|".join(r"\s+".join(re.escape(w) for w in p.split()) for p in torn)
        self.protected = re.compile(rf"(?<!\w)(?:{pattern})(?!\w)", re.I) if torn else None
        self.protected_re2 = f"(?i)(?:{pattern})" if torn else None

    def lists(self, texts: pa.Array) -> pa.Array:
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        if n == 0:
            return pa.array([], pa.large_list(pa.large_string()))
        _, off, buf = texts.buffers()
        offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1]
        data = np.frombuffer(buf, np.uint8)[offsets[0] : offsets[-1]] if buf is not None else np.zeros(0, np.uint8)
        begins, ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
        if data.size == 0:
            return pa.LargeListArray.from_arrays(pa.array(np.zeros(n + 1, np.int64)), pa.array([], pa.large_string()))
        row = np.repeat(np.arange(n), ends - begins)
        blank = np.isin(data, np.frombuffer(BLANKS, np.uint8))

        # first and last sign of each row that is no blank
        solid = np.flatnonzero(~blank)
        first = np.full(n, -1)
        last = np.full(n, -1)
        first[row[solid][::-1]] = solid[::-1]
        last[row[solid]] = solid
        filled = first >= 0
        listed = np.zeros(n, bool)
        listed[filled] = (data[first[filled]] == ord("[")) & (data[last[filled]] == ord("]")) & (first[filled] < last[filled])

        # quote parity, from the start of each row
        double, single = data == ord('"'), data == ord("'")
        in_list = listed[row]
        kinds = np.zeros(n, np.uint8)
        if in_list.any():
            marks = np.flatnonzero((double | single) & in_list)
            kinds[row[marks][::-1]] = data[marks][::-1]  # the first quote of a list is its kind
        quote = np.where(in_list, (data == kinds[row]) & (kinds[row] > 0), double)
        count = np.cumsum(quote)
        base = np.concatenate([[0], count])[begins]
        inside = ((count - base[row]) & 1).astype(bool)  # an opening quote counts as inside, a closing one as outside

        odd = np.zeros(n, bool)
        totals = np.concatenate([[0], count])[ends] - base
        odd |= (totals & 1).astype(bool)
        if in_list.any():
            odd[row[(data == ord("\\")) & in_list]] = True
            other = (double | single) & in_list & ~quote
            odd[row[other]] = True
        opening = np.flatnonzero(quote & inside & ~in_list)
        if opening.size:
            before = np.where(opening > begins[row[opening]], data[np.maximum(opening - 1, 0)], ord(" "))
            fair = np.isin(before, np.frombuffer(BLANKS + b'";,|/+', np.uint8)) | (before >= 0x80)
            odd[row[opening[~fair]]] = True

        # delimiters
        cut = np.zeros(len(data), bool)
        gone = np.zeros(len(data), bool)
        outside = ~inside & ~in_list
        for d in self.delimiters:
            hit = np.flatnonzero(_runs(data, d) & outside)
            if len(d) > 1:
                hit = hit[hit + len(d) <= ends[row[hit]]]
            cut[hit] = True
            for k in range(len(d)):
                gone[hit + k] = True
        commas = (data == ord(",")) & ~inside & in_list
        cut |= commas
        gone |= commas
        brackets = np.concatenate([first[listed], last[listed]])
        gone[brackets] = True
        if self.protected is not None:
            may = pc.fill_null(pc.match_substring_regex(texts, self.protected_re2), False)
            for i in np.flatnonzero(may.to_numpy(zero_copy_only=False) & ~listed):
                text = texts[int(i)].as_py()
                for m in self.protected.finditer(text):
                    a = begins[i] + len(text[: m.start()].encode())
                    b = a + len(m.group().encode())
                    cut[a:b] = False
                    gone[a:b] = False

        # child offsets: the bytes of delimiters and brackets are dropped, so values lie side by side
        at = np.flatnonzero(cut)
        parents = np.concatenate([np.arange(n), row[at]])
        starts = np.concatenate([begins, at + 1])
        order = np.lexsort((starts, parents))
        parents, starts = parents[order], starts[order]
        kept = np.concatenate([[0], np.cumsum(~gone)])
        child = np.append(kept[starts], kept[-1]).astype(np.int64)
        body = data[~gone]
        values = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(child), pa.py_buffer(body)])
        values = pc.utf8_trim_whitespace(values)
        long = pc.greater_equal(pc.utf8_length(values), 2)
        kind = kinds[parents]
        for q in ('"', "'"):
            own = pa.array(kind == ord("'") if q == "'" else kind != ord("'"))
            wrapped = pc.and_(pc.and_(pc.and_(pc.starts_with(values, q), pc.ends_with(values, q)), long), own)
            if pc.any(wrapped).as_py():
                bare = pc.utf8_slice_codeunits(values, 1, -1)
                if q == '"':
                    bare = pc.replace_substring(bare, '""', '"')
                values = pc.if_else(wrapped, pc.utf8_trim_whitespace(bare), values)
        stays = (pc.greater(pc.utf8_length(values), 0)).to_numpy(zero_copy_only=False) & ~odd[parents]
        values, parents = values.filter(pa.array(stays)), parents[stays]
        strange = np.flatnonzero(odd & filled)
        if strange.size:
            extra_v, extra_p = [], []
            for i in strange:
                text = texts[int(i)].as_py()
                got = _literal(text) if listed[i] else _irregular(text, self.cutter, self.protected)
                extra_v += got
                extra_p += [int(i)] * len(got)
            parents = np.concatenate([parents, np.array(extra_p, parents.dtype)])
            values = pa.concat_arrays([values, pa.array(extra_v, pa.large_string())])
            order = np.argsort(parents, kind="stable")
            parents, values = parents[order], values.take(pa.array(order))
        sizes = np.bincount(parents, minlength=n)
        return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)])), values)


def unpack(df: DataFrame, column: str, *, delimiters: Sequence[str] = VALUE_DELIMITERS, protected: Sequence[str] = (), pos: str = "pos", val: str = "val") -> DataFrame:
    """One row per value of `column`: the other columns, then `pos` (int, from 1) and `val`.

    `protected`: names that are not cut; a bounded list that travels with the tasks.  Columns of df
    that bear the names of `pos` or `val` give way to those made here.
    """
    others = [c for c in df.columns if c not in (column, pos, val)]
    schema = T.StructType([*(df.schema[c] for c in others), T.StructField(pos, T.IntegerType()), T.StructField(val, T.StringType())])
    delimiters, protected = tuple(delimiters), tuple(protected)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = Unpacker(delimiters, protected)
        for batch in batches:
            lists = unpacker.lists(batch.column(column))
            parents = pc.list_parent_indices(lists)
            offsets = lists.offsets.to_numpy()
            p = parents.to_numpy(zero_copy_only=False)
            place = (np.arange(len(p)) - (offsets[p] - offsets[0]) + 1).astype(np.int32)
            arrays = [batch.column(c).take(parents) for c in others]
            arrays += [pa.array(place), lists.flatten().cast(pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*others, pos, val])

    return df.select(*others, column).mapInArrow(scan, schema)
