"""Small directories of tables for tests: as given, dirty, and empty."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

GIVEN = Path("/root/testdata/sf0.001")


def dirty(to: Path, rows: int = 60) -> Path:
    """The first rows of every table, one row of nulls, one of empty texts, one very long text, repeated rows, and columns whose names clash with an operator's own."""
    to.mkdir(parents=True, exist_ok=True)
    for path in GIVEN.glob("*.parquet"):
        table = pq.read_table(path)
        base = table.slice(0, min(rows, table.num_rows)).to_pylist()
        extra = []
        if path.stem not in ("mixture_targets", "pack_sizes", "name_parts"):
            extra = [dict.fromkeys(table.column_names)]
            text = next((c for c in ("text", "content") if c in table.column_names), None)
            for i, value in enumerate(("", " \n\t", "word " * 40_000, "x" * 200_000)):
                if text and base:
                    own = dict(base[0]) | {text: value}
                    key = next((c for c in ("id", "hash", "chunk_id", "doc_id", "fetch_id") if c in own), None)
                    own[key] = f"odd-{i}" if isinstance(own[key], str) else 10_000_000 + i
                    extra.append(own)
            if "messages" in table.column_names and base:
                odd = [None, [], [None], [{"role": None, "content": None}], [{"role": "user", "content": ""}, {"role": "assistant", "content": "word " * 30_000}]]
                extra += [dict(base[0]) | {"id": f"odd-{i}", "messages": m} for i, m in enumerate(odd)]
        out = pa.Table.from_pylist(base + extra + base[:5], schema=table.schema)
        for name in ("rid", "words", "tbl", "key", "tokens", "place", "part", "n", "a", "b", "rank", "size", "class", "stats", "kind", "line_no", "votes", "spans"):
            if name not in out.column_names:
                out = out.append_column(name, pa.array(["clash"] * out.num_rows))
        pq.write_table(out, to / path.name)
    return to


def empty(to: Path) -> Path:
    """Every table without rows."""
    to.mkdir(parents=True, exist_ok=True)
    for path in GIVEN.glob("*.parquet"):
        pq.write_table(pq.read_table(path).slice(0, 0), to / path.name)
    return to


def sql_rows(folder: Path, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in folder.glob("*.parquet"):
        con.execute(f"create view \"{path.stem}\" as select * from '{path}'")
    cursor = con.execute(sql)
    return [c[0] for c in cursor.description], cursor.fetchall()


def comparable(value):
    if isinstance(value, float):
        return round(value, 6)
    if hasattr(value, "quantize"):
        return round(float(value), 6)
    if hasattr(value, "tzinfo"):
        return value.replace(tzinfo=None)
    return value
