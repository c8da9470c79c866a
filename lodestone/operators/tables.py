"""Fact tables as sets of rows: distinct, prefix and range scans, inversion, encoding of facts into an index."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import dictionary
from lodestone.schema import DICTIONARIES, LOCAL_TYPES, PATH_TYPE, REFERENCE, TABLES
from lodestone.sources.keyed import Keyed, write_keyed
from lodestone.sources.store import layout, materialise


def distinct_rows(df: DataFrame) -> DataFrame:
    """A table is a set: repeated rows collapse."""
    return df.distinct()


def at_least(columns: list[str], key: list[object]) -> Column:
    """Rows at or after a key in lexicographic order; a key may be a prefix of the columns.

    Expanded to comparisons of single columns, so that they reach the scan.
    """
    out = F.lit(True)
    for c, k in reversed(list(zip(columns, key, strict=False))):
        out = (F.col(c) > k) | ((F.col(c) == k) & out)
    return out


def lower_bound(df: DataFrame, columns: list[str], key: list[object]) -> DataFrame:
    """The first row at or after the key."""
    return df.where(at_least(columns, key)).orderBy(*columns).limit(1)


def prefix_scan(df: DataFrame, key: dict[str, object]) -> DataFrame:
    """Rows whose leading columns equal the key."""
    for c, k in key.items():
        df = df.where(F.col(c) == k)
    return df


def line_range(df: DataFrame, file: object, first: int = 0, last: int = (1 << 31) - 1) -> DataFrame:
    """Rows of one file on lines first to last, both included."""
    return df.where((F.col("file") == file) & F.col("line").between(first, last))


def invert(df: DataFrame, columns: list[str]) -> DataFrame:
    """The same rows with other leading columns."""
    return df.select(*columns)


@dataclass
class CodeIndex:
    """Dictionaries (id, value) and encoded tables by name."""

    dictionaries: dict[str, DataFrame] = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def add_table(self, name: str, df: DataFrame) -> None:
        """Add a table; one of the same name must have the same columns."""
        if name in self.tables and self.tables[name].columns != df.columns:
            raise ValueError(f"{name} has columns {self.tables[name].columns}, not {df.columns}")
        self.tables.setdefault(name, df)

    def table(self, name: str) -> DataFrame | None:
        return self.tables.get(name)

    def table_names(self) -> list[str]:
        return sorted(self.tables)

    def dictionary_names(self) -> list[str]:
        return sorted(self.dictionaries)

    def decoded(self, name: str) -> DataFrame:
        """A table with its ids replaced by values (columns without _id)."""
        df = self.tables[name]
        for column, dict_name in TABLES[name].items():
            if dict_name:
                df = dictionary.decode(df, self.dictionaries[dict_name], column, column.removesuffix("_id"))
        return df.select(*[c.removesuffix("_id") for c in TABLES[name]])

    def write(self, path: str, compression: str = "snappy") -> None:
        """Every part in the order of its keys, a dictionary by value, with the first keys of its files."""
        for name, df in self.dictionaries.items():
            write_keyed(df, f"{path}/dictionaries/{name}", ["value", "id"], compression=compression)
        for name, df in self.tables.items():
            write_keyed(df, f"{path}/tables/{name}", df.columns, compression=compression)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> CodeIndex:
        if layout(spark, path) != "index":
            raise ValueError(f"not an index: {path}")
        return cls({n: spark.read.parquet(f"{path}/dictionaries/{n}") for n in DICTIONARIES}, {n: spark.read.parquet(f"{path}/tables/{n}") for n in TABLES})


def written_references(spark: SparkSession, path: str, symbols: DataFrame) -> DataFrame:
    """The references of symbols (symbol) in the index written at path, as facts; of dictionary and table only the files that can hold them are read."""
    names = Keyed(spark, f"{path}/dictionaries/Symbol").lookup(symbols.select(F.col("symbol").alias("value")))
    rows = Keyed(spark, f"{path}/tables/ReferenceIndex").lookup(names.select(F.col("id").alias("symbol_id")))
    index = CodeIndex.read(spark, path)
    rows = rows.join(names.select(F.col("id").alias("symbol_id"), F.col("value").alias("symbol")), "symbol_id")
    for column, name in (("file_id", "Symbol"), ("kind_id", "ReferenceType")):
        rows = dictionary.decode(rows, index.dictionaries[name], column, column.removesuffix("_id"))
    return rows.select(*REFERENCE)


def symbol_rows(facts: DataFrame) -> DataFrame:
    """symbol, symbol_type of facts, with a Path symbol for each file."""
    own = facts.where("symbol_type IS NOT NULL").select("symbol", "symbol_type")
    return own.unionByName(facts.select(F.col("file").alias("symbol"), F.lit(PATH_TYPE).alias("symbol_type"))).distinct()


def global_symbols(symbols: DataFrame) -> DataFrame:
    """Symbols that are not local and not paths."""
    return symbols.where(~F.col("symbol_type").isin(*LOCAL_TYPES, PATH_TYPE)).select("symbol").distinct()


def build_index(facts: DataFrame, once: bool = False) -> CodeIndex:
    """Encode facts (file, line, start_col, end_col, symbol, kind, symbol_type) into an index.

    Distinct facts are written, for the dictionaries and tables made of them. once:
    coded rows are written too, for indexes whose tables are all written; each is
    read twice there, by the range partitioning.
    """
    refs = materialise(facts.select("file", "line", "start_col", "end_col", "symbol", "kind").distinct())
    symbols = materialise(symbol_rows(facts))
    names = refs.select(F.col("file").alias("v")).unionByName(refs.select(F.col("symbol").alias("v"))).unionByName(symbols.select(F.col("symbol").alias("v")))
    index = CodeIndex({"Symbol": dictionary.encode(names, "v"), "SymbolType": dictionary.encode(symbols, "symbol_type"), "ReferenceType": dictionary.encode(refs, "kind")})
    ids = lambda name, key: index.dictionaries[name].select(F.col("id").alias(f"{key}_id"), F.col("value").alias(key))
    coded = refs.join(ids("Symbol", "file"), "file").join(ids("Symbol", "symbol"), "symbol").join(ids("ReferenceType", "kind"), "kind")
    typed = symbols.join(ids("Symbol", "symbol"), "symbol").join(ids("SymbolType", "symbol_type"), "symbol_type").withColumnRenamed("symbol_type_id", "type_id")
    if once:
        coded, typed = materialise(coded.select(*TABLES["Reference"])), materialise(typed.select(*TABLES["Symbol"]))
    sources = {"Reference": coded, "ReferenceIndex": coded, "Symbol": typed, "SymbolTypeIndex": typed, "GlobalSymbol": global_symbols(symbols).join(ids("Symbol", "symbol"), "symbol")}
    for name, columns in TABLES.items():
        index.add_table(name, sources[name].select(*columns))
    return index


def row_width(values: list[Column]) -> Column:
    """Bytes of a row in a variable-length code of seven bits a byte (the value plus one is stored), with one end byte."""
    def width(v: Column) -> Column:
        x = v + 1
        out = F.lit(1)
        for k in (7, 14, 21, 28):
            out = out + F.when(x >= 1 << k, 1).otherwise(0)
        return out

    total = F.lit(1)
    for v in values:
        total = total + width(v)
    return total.cast("bigint")
