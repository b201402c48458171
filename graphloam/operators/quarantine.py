"""Rows that fail to parse, with the reason, while the valid rows load.

Records are read in blocks on a columnar path.  One regular expression over the
block parts records of a wrong shape from the rest, which one CSV read cuts into
columns and one cast per column makes typed.  A cast that fails is tried on both
halves of the block, and on their halves again, with the columns that did
convert kept, until what fails is a few records; those, and the records of a
wrong shape, go through a strict reader which names the reason.  The columnar
path accepts nothing that the strict reader would refuse.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pcsv
from pyspark.sql import DataFrame, functions as F, types as T

MAX_DEFINITIONS = 10_000
BLOCK_ROWS = 4096
BLOCK_BYTES = 16 << 20
LEAF_ROWS = 16
#: The characters with the Unicode property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"

CELL = pa.struct([("text", pa.string()), ("int", pa.int64()), ("bool", pa.bool_())])
CELLS = pa.map_(pa.string(), CELL)
CELLS_DDL = "map<string,struct<text:string,int:bigint,bool:boolean>>"


class Refused(Exception):
    """A block holds a record that does not load; for one record, why."""


class _Form:
    """A way to read records: ``shaped``, ``columns``, ``convert`` and ``fits``
    for blocks, ``record`` for one by one."""

    def block(self, raw: pa.Array) -> list[pa.Array]:
        """The typed columns of a whole block, or Refused."""
        if not self.shaped(raw).all():
            raise Refused
        done = [self.convert(k, text) for k, text in enumerate(self.columns(raw))]
        if not self.fits(done):
            raise Refused
        return done


@dataclass(frozen=True)
class Delimited(_Form):
    """Records with separated cells, quoted as in RFC 4180, of typed columns."""

    sep: str
    names: tuple[str, ...]
    types: tuple[str, ...]

    def __post_init__(self) -> None:
        if not self.sep or len(self.names) != len(self.types) or set(self.types) - {"string", "int", "bool"}:
            raise ValueError(f"not a definition of delimited records: {self}")

    @property
    def _shape(self) -> str:
        cell = '(?:"(?:[^"]|"")*"|[^"\\r\\n%s]*)' % re.escape(self.sep)
        more = f"(?:{re.escape(self.sep)}{cell})"
        # the engine bounds repeat counts, so many columns are written out in parts
        n = len(self.names) - 1
        return f"\\A{cell}" + f"{more}{{500}}" * (n // 500) + f"{more}{{{n % 500}}}\\z"

    def shaped(self, raw: pa.Array) -> np.ndarray:
        """Which records have this form's number of cells, quoted well."""
        if len(self.sep) != 1 or not self.sep.isascii() or self.sep in '"\r\n' or len(self.names) > 2000:
            return np.zeros(len(raw), bool)
        return pc.fill_null(pc.match_substring_regex(raw, self._shape), False).to_numpy(zero_copy_only=False)

    def columns(self, raw: pa.Array) -> list[pa.Array]:
        """The cells of well-shaped records as columns of text, or Refused."""
        # an empty first record keeps the reader from taking a byte order mark away
        data = (self.sep * (len(self.names) - 1) + "\n" + "\n".join(raw.to_pylist()) + "\n").encode()
        try:
            table = pcsv.read_csv(
                io.BytesIO(data),
                pcsv.ReadOptions(column_names=self.names, use_threads=False, block_size=len(data) + 1),
                pcsv.ParseOptions(delimiter=self.sep, newlines_in_values=True, ignore_empty_lines=False),
                pcsv.ConvertOptions(column_types=dict.fromkeys(self.names, pa.string()), strings_can_be_null=False),
            ).slice(1)
        except pa.ArrowInvalid:
            raise Refused from None
        if table.num_rows != len(raw):
            raise Refused
        return [pa.concat_arrays(x.chunks) if x.num_chunks else pa.array([], pa.string()) for x in table.columns]

    def fits(self, columns: list[pa.Array]) -> bool:
        return True

    def convert(self, column: int, text: pa.Array) -> pa.Array:
        """A column of text as cells of its type, or Refused."""
        try:
            return self._typed(text, self.types[column])
        except pa.ArrowInvalid:
            raise Refused from None

    @staticmethod
    def _typed(text: pa.Array, kind: str) -> pa.Array:
        none = lambda t: pa.nulls(len(text), t)
        if kind == "string":
            return pa.StructArray.from_arrays([text, none(pa.int64()), none(pa.bool_())], fields=list(CELL))
        text = pc.utf8_trim(text, " ")
        if kind == "bool":
            yes = pc.equal(text, "true")
            if not pc.all(pc.or_(yes, pc.equal(text, "false"))).as_py():
                raise Refused
            return pa.StructArray.from_arrays([none(pa.string()), none(pa.int64()), yes], fields=list(CELL))
        if not pc.all(pc.match_substring_regex(text, "\\A[+-]?[0-9]+\\z")).as_py():
            raise Refused
        plain = pc.replace_substring_regex(pc.replace_substring_regex(text, "\\A\\+", ""), "\\A(-?)0+([0-9])", "\\1\\2")
        return pa.StructArray.from_arrays([none(pa.string()), plain.cast(pa.int64()), none(pa.bool_())], fields=list(CELL))

    def record(self, raw: str | None) -> list[dict]:
        """The cells of one record; Refused with the reason."""
        cells = self._cells(raw)
        if len(cells) != len(self.names):
            raise Refused(f"{len(cells)} cells instead of {len(self.names)}")
        out = []
        for name, kind, text in zip(self.names, self.types, cells):
            if kind == "string":
                out.append({"text": text, "int": None, "bool": None})
                continue
            text = text.strip(" ")
            if kind == "bool":
                if text not in ("true", "false"):
                    raise Refused(f"column {name}: not a bool")
                out.append({"text": None, "int": None, "bool": text == "true"})
                continue
            digits = text[1:] if text[:1] in ("+", "-") else text
            if not digits.isascii() or not digits.isdigit():
                raise Refused(f"column {name}: not an int")
            digits = digits.lstrip("0") or "0"
            value = int(digits) if len(digits) < 20 else 1 << 64
            value = -value if text[0] == "-" else value
            if not -(1 << 63) <= value < 1 << 63:
                raise Refused(f"column {name}: int beyond 64 bits")
            out.append({"text": None, "int": value, "bool": None})
        return out

    def _cells(self, raw: str | None) -> list[str]:
        if raw is None:
            raise Refused("no record")
        cells, at, sep = [], 0, self.sep
        while True:
            if raw.startswith('"', at):
                text, at = [], at + 1
                while True:
                    end = raw.find('"', at)
                    if end < 0:
                        raise Refused("quote not closed")
                    text.append(raw[at:end])
                    at = end + 1
                    if not raw.startswith('"', at):
                        break
                    text.append('"')
                    at += 1
                if at < len(raw) and not raw.startswith(sep, at):
                    raise Refused("text after a closing quote")
                cells.append("".join(text))
            else:
                end = raw.find(sep, at)
                cell = raw[at:] if end < 0 else raw[at:end]
                if '"' in cell:
                    raise Refused("quote in an unquoted cell")
                if "\n" in cell or "\r" in cell:
                    raise Refused("line break in an unquoted cell")
                cells.append(cell)
                at += len(cell)
            if at >= len(raw):
                return cells
            at += len(sep)


@dataclass(frozen=True)
class Endpoint(_Form):
    """``LABEL=field[,field...]`` with as many fields as the label has key fields."""

    labels: tuple[str, ...]
    n_fields: tuple[int, ...]

    def _numbers(self, labels: pa.Array) -> pa.Array:
        return pc.index_in(labels, pa.array(self.labels, pa.string()))

    def shaped(self, raw: pa.Array) -> np.ndarray:
        """Which texts have a = at all."""
        return pc.fill_null(pc.match_substring(raw, "="), False).to_numpy(zero_copy_only=False)

    def columns(self, raw: pa.Array) -> list[pa.Array]:
        """What stands before the first = and what after it."""
        flat = pc.split_pattern(raw, "=", max_splits=1).flatten()
        return [flat.take(pa.array(np.arange(i, len(flat), 2))) for i in (0, 1)]

    def convert(self, column: int, text: pa.Array) -> pa.Array:
        """Labels as they are, the rest as lists of fields; Refused if a label is none."""
        if column == 0:
            if self._numbers(text).null_count:
                raise Refused
            return text
        split = pc.split_pattern(text, ",")
        row = pc.list_parent_indices(split).to_numpy()
        field = pc.utf8_trim(split.flatten(), WHITE_SPACE)
        full = pc.not_equal(field, "").to_numpy(zero_copy_only=False)
        kept = np.bincount(row[full], minlength=len(text))
        offsets = pa.array(np.concatenate([[0], np.cumsum(kept)]).astype("int32"))
        return pa.ListArray.from_arrays(offsets, field.filter(pa.array(full)))

    def fits(self, columns: list[pa.Array]) -> bool:
        """As many fields as the label has key fields, throughout."""
        need = np.array(self.n_fields, int)[self._numbers(columns[0]).to_numpy()]
        return bool((pc.list_value_length(columns[1]).to_numpy(zero_copy_only=False) == need).all())

    def record(self, raw: str | None) -> list:
        if raw is None:
            raise Refused("no text")
        head, equals, rest = raw.partition("=")
        if not equals:
            raise Refused("no =")
        if head not in self.labels:
            raise Refused("not a label")
        fields = [x for x in (f.strip(WHITE_SPACE) for f in rest.split(",")) if x]
        need = self.n_fields[self.labels.index(head)]
        if len(fields) != need:
            raise Refused(f"{len(fields)} fields instead of {need}")
        return [head, fields]


@dataclass
class _Read:
    """What became of the records of a batch: blocks of typed columns with the
    places of their records, single records, and reasons."""

    blocks: list[tuple[np.ndarray, list[pa.Array]]]
    single: list[tuple[int, list]]
    bad: list[tuple[int, str]]

    def strictly(self, form, raw: pa.Array, places) -> None:
        for i in places:
            try:
                self.single.append((int(i), form.record(raw[int(i)].as_py())))
            except Refused as why:
                self.bad.append((int(i), str(why)))

    def block(self, form, raw: pa.Array, lo: int, hi: int) -> None:
        """The records from *lo* to *hi*."""
        own = raw.slice(lo, hi - lo)
        shaped = form.shaped(own)
        self.strictly(form, raw, lo + np.flatnonzero(~shaped))
        places = lo + np.flatnonzero(shaped)
        if len(places):
            self._cut(form, raw, own.filter(pa.array(shaped)), places)

    def _cut(self, form, raw: pa.Array, own: pa.Array, places: np.ndarray) -> None:
        """Cut records into columns; halve what the columnar reader refuses."""
        try:
            text = form.columns(own)
        except Refused:
            if len(places) <= LEAF_ROWS:
                return self.strictly(form, raw, places)
            mid = len(places) // 2
            self._cut(form, raw, own.slice(0, mid), places[:mid])
            return self._cut(form, raw, own.slice(mid), places[mid:])
        self._convert(form, raw, text, [None] * len(text), places)

    def _convert(self, form, raw: pa.Array, text: list[pa.Array], done: list, places: np.ndarray) -> None:
        """Convert the columns that aren't yet; halve the records if one fails."""
        done, failed = list(done), False
        for k, column in enumerate(text):
            if done[k] is None:
                try:
                    done[k] = form.convert(k, column)
                except Refused:
                    failed = True
        if not failed and form.fits(done):
            self.blocks.append((places, done))
            return
        if len(places) <= LEAF_ROWS:
            return self.strictly(form, raw, places)
        mid = len(places) // 2
        for lo, n in ((0, mid), (mid, len(places) - mid)):
            self._convert(form, raw, [x.slice(lo, n) for x in text], [None if x is None else x.slice(lo, n) for x in done], places[lo : lo + n])


def _blocks(raw: pa.Array) -> Iterator[tuple[int, int]]:
    """Stretches of at most BLOCK_ROWS records and about BLOCK_BYTES."""
    size = pc.fill_null(pc.binary_length(raw), 0).to_numpy()
    lo, held = 0, 0
    for i in range(len(raw)):
        held += int(size[i])
        if i + 1 - lo == BLOCK_ROWS or held > BLOCK_BYTES:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(raw):
        yield lo, len(raw)


def _delimited_values(form: Delimited, read: _Read) -> tuple[np.ndarray, pa.Array]:
    """Places and the maps of cells of the records that loaded."""
    k = len(form.names)
    items = []
    for places, columns in read.blocks:
        m = len(places)
        items.append(pa.concat_arrays(columns).take(pa.array(np.arange(k * m).reshape(k, m).T.ravel())))
    if read.single:
        items.append(pa.array([cell for _, record in read.single for cell in record], CELL))
    at = np.concatenate([np.array([], int), *[p for p, _ in read.blocks], np.array([i for i, _ in read.single], int)])
    names = pa.array(form.names).take(pa.array(np.tile(np.arange(k), len(at))))
    return at, pa.MapArray.from_arrays(pa.array((np.arange(len(at) + 1) * k).astype("int32")), names, pa.concat_arrays(items) if items else pa.array([], CELL))


def _endpoint_values(form: Endpoint, read: _Read) -> tuple[np.ndarray, pa.Array]:
    kind = pa.struct([("label", pa.string()), ("fields", pa.list_(pa.string()))])
    parts = [pa.StructArray.from_arrays(c, fields=list(kind)) for _, c in read.blocks]
    parts.append(pa.array([{"label": r[0], "fields": r[1]} for _, r in read.single], kind))
    return np.concatenate([np.array([], int), *[p for p, _ in read.blocks], np.array([i for i, _ in read.single], int)]), pa.concat_arrays(parts)


def _reader(forms: dict, values, value_type: pa.DataType, with_values: bool):
    def rows(ids: pa.Array, reasons: pa.Array, found) -> pa.RecordBatch:
        columns = {"id": ids, "reason": reasons} | ({"value": found} if with_values else {})
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, which, raw = batch.column(0), batch.column(1), batch.column(2)
            if pa.types.is_large_string(raw.type):
                raw = raw.cast(pa.string())
            codes = pc.dictionary_encode(which, null_encoding="encode")
            for code, name in enumerate(codes.dictionary.to_pylist()):
                at = np.flatnonzero(codes.indices.to_numpy() == code)
                if not len(at):
                    continue
                form, own, got = forms.get(name), raw.take(pa.array(at)), _Read([], [], [])
                if form is None:
                    got.bad = [(i, "no definition") for i in range(len(at))]
                else:
                    for lo, hi in _blocks(own):
                        got.block(form, own, lo, hi)
                if got.blocks or got.single:
                    if with_values:
                        good, found = values(form, got)
                        found = found.cast(value_type)
                    else:
                        good, found = np.concatenate([np.array([], int), *[p for p, _ in got.blocks], np.array([i for i, _ in got.single], int)]), None
                    yield rows(ids.take(pa.array(at[good])), pa.nulls(len(good), pa.string()), found)
                if got.bad:
                    bad = np.array([i for i, _ in got.bad])
                    yield rows(ids.take(pa.array(at[bad])), pa.array([r for _, r in got.bad]), pa.nulls(len(bad), value_type))

    return read


def _schema(kind: T.DataType, value: str, with_values: bool) -> T.StructType:
    fields = [T.StructField("id", kind), T.StructField("reason", T.StringType())]
    return T.StructType(fields + (T._parse_datatype_string(value).fields if with_values else []))


def _definitions(df: DataFrame, what: str) -> list:
    """Definitions are few; more than MAX_DEFINITIONS are refused, never cut."""
    rows = df.limit(MAX_DEFINITIONS + 1).collect()
    if len(rows) > MAX_DEFINITIONS:
        raise ValueError(f"more than {MAX_DEFINITIONS} {what}")
    return rows


def parse_lines(lines: DataFrame, feeds: DataFrame, *, row_id: str = "line_id", feed: str = "feed", raw: str = "raw", with_values: bool = True) -> DataFrame:
    """Every row of *lines* as ``id``, ``reason`` (null: it loads) and
    ``value``, a map from column name to a cell of which ``text``, ``int`` or
    ``bool`` is set by the column's type (``typed`` makes columns of it); all
    cells are converted without *with_values* too, but not returned.

    *feeds* has ``feed, sep, column_names, column_types``.  A null record and a
    line of an unknown or null feed are refused with that reason; an empty
    record is one empty cell.  Repeated rows and null ids come out as they are;
    a feed defined twice or with unknown types raises.  Further columns are
    ignored.  Empty input gives an empty result.
    """
    forms: dict = {}
    for r in _definitions(feeds.select("feed", "sep", "column_names", "column_types"), "feeds"):
        if r["feed"] in forms:
            raise ValueError(f"feed defined twice: {r['feed']}")
        forms[r["feed"]] = Delimited(r["sep"], tuple(r["column_names"]), tuple(r["column_types"]))
    kind = lines.schema[row_id].dataType
    source = lines.select(F.col(row_id).alias("id"), F.col(feed).alias("feed"), F.col(raw).alias("raw"))
    return source.mapInArrow(_reader(forms, _delimited_values, CELLS, with_values), _schema(kind, f"value {CELLS_DDL}", with_values))


def parse_endpoints(specs: DataFrame, labels: DataFrame, *, row_id: str = "spec_id", spec: str = "spec", with_values: bool = True) -> DataFrame:
    """Every row of *specs* as ``id``, ``reason`` (null: it is usable) and
    ``value``, a struct of ``label`` and ``fields``.

    *labels* has ``label, key_fields``.  The label must match exactly; fields
    are trimmed of white space, empty ones dropped; null texts are refused.
    """
    rows = [r for r in _definitions(labels.select("label", "key_fields"), "labels") if r["label"] is not None]
    if len({r["label"] for r in rows}) != len(rows):
        raise ValueError("label defined twice")
    form = Endpoint(tuple(r["label"] for r in rows), tuple(len(r["key_fields"] or []) for r in rows))
    kind = specs.schema[row_id].dataType
    value = pa.struct([("label", pa.string()), ("fields", pa.list_(pa.string()))])
    source = specs.select(F.col(row_id).alias("id"), F.lit("").alias("feed"), F.col(spec).alias("raw"))
    return source.mapInArrow(_reader({"": form}, _endpoint_values, value, with_values), _schema(kind, "value struct<label:string,fields:array<string>>", with_values))


def typed(parsed: DataFrame, names: list[str], types: list[str]) -> DataFrame:
    """The rows that load as ``id`` and one typed column for each cell."""
    field = {"string": "text", "int": "int", "bool": "bool"}
    return parsed.filter("reason is null").select("id", *[F.element_at("value", n).getField(field[t]).alias(n) for n, t in zip(names, types)])
