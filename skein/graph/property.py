"""Property graphs: a directed graph with attribute tables for nodes and edges, and the queries over them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DecimalType, DoubleType, FloatType, IntegerType, LongType, StringType

from skein.graph.core import DiGraph

_KINDS = (LongType, IntegerType, FloatType, DoubleType, BooleanType, StringType, DecimalType)
_ORDER = "_input_order"

#: Comparison operators of property queries by name.
OPS: dict[str, Callable[[Column, object], Column]] = {
    "<": lambda c, v: c < v,
    ">": lambda c, v: c > v,
    "<=": lambda c, v: c <= v,
    ">=": lambda c, v: c >= v,
    "==": lambda c, v: c == v,
    "<>": lambda c, v: c != v,
    "contains": lambda c, v: c.contains(v),
}


def no_filter(_: DataFrame) -> Column:
    return F.lit(True)


def first_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str] | None) -> DataFrame:
    """The first row of each key, by ``order_by`` or else in input order; combines on the map side."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(list(keys))
    rows = df.withColumn(_ORDER, F.struct(*order_by) if order_by else F.monotonically_increasing_id())
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), _ORDER).alias("_first"))
    return first.select(*keys, *(F.col(f"_first.`{c}`").alias(c) for c in rest))


def _checked(df: DataFrame, skip: Sequence[str] = ()) -> None:
    for f in df.schema:
        if f.name not in skip and not isinstance(f.dataType, _KINDS):
            raise TypeError(f"column {f.name} has a type that attributes can't have: {f.dataType.simpleString()}")


class PropGraph(DiGraph):
    """A DiGraph whose nodes have labels and properties, and whose edges have relationships and properties.

    Labels and relationships are columns whose names are registered as such; all other columns are properties.
    """

    def __init__(self) -> None:
        super().__init__()
        self._nodes_table: DataFrame | None = None
        self._edges_table: DataFrame | None = None
        self.label_columns: list[str] = []
        self.relationship_columns: list[str] = []

    # --- loading

    def load_edge_attributes(self, df: DataFrame, source_column: str, destination_column: str, relationship_columns: Sequence[str] | None = None, convert_string_relationships_to_categoricals: bool = True, no_self_loops: bool = True, order_by: Sequence[str] | None = None) -> PropGraph:
        """Take edges and their attributes from ``df``; of rows for the same pair the first counts, loops are dropped.

        Strings stay strings: Parquet and the columnar cache code them by dictionary anyway.
        """
        _checked(df, (source_column, destination_column))
        missing = set(relationship_columns or ()) - set(df.columns)
        if missing:
            raise KeyError(f"no columns {sorted(missing)}")
        rows = df.where(F.col(source_column).isNotNull() & F.col(destination_column).isNotNull())
        rows = rows.where(F.col(source_column) != F.col(destination_column)) if no_self_loops else rows
        first = first_per_key(rows, (source_column, destination_column), order_by)
        first = first.withColumnRenamed(source_column, "src").withColumnRenamed(destination_column, "dst")
        self._edges_table = first.withColumns({"src": F.col("src").cast("long"), "dst": F.col("dst").cast("long")}).persist()
        self.relationship_columns = list(relationship_columns or ())
        self._set(self._edges_table.select("src", "dst"), no_self_loops)
        return self

    def load_node_attributes(self, df: DataFrame, node_column: str, label_columns: Sequence[str] | None = None, convert_string_labels_to_categoricals: bool = True, order_by: Sequence[str] | None = None) -> PropGraph:
        """Take node attributes from ``df``; the first row of a node counts, nodes that no edge has are left out."""
        self._need_edges()
        _checked(df, (node_column,))
        missing = set(label_columns or ()) - set(df.columns)
        if missing:
            raise KeyError(f"no columns {sorted(missing)}")
        first = first_per_key(df.where(F.col(node_column).isNotNull()), (node_column,), order_by).withColumnRenamed(node_column, "id")
        first = first.withColumn("id", F.col("id").cast("long"))
        self._nodes_table = first.join(self.nodes(), "id", "left_semi").persist()
        self.label_columns = list(label_columns or ())
        return self

    def _need_edges(self) -> None:
        if self._edges is None:
            raise ValueError("load the edges first")

    def _added(self, table: DataFrame | None, base: DataFrame, new: DataFrame, keys: list[str], order_by) -> DataFrame:
        names = [c for c in new.columns if c not in keys]
        repeated = [c for c in names if table is not None and c in table.columns]
        if repeated:
            raise KeyError(f"columns {repeated} are there already")
        _checked(new, keys)
        first = first_per_key(new.where(" and ".join(f"{k} is not null" for k in keys)), keys, order_by)
        return (table if table is not None else base).join(first, keys, "left").persist()

    def add_node_labels(self, labels: DataFrame, node_column: str, assume_sorted: bool = False, convert_strings_to_categoricals: bool = True, order_by: Sequence[str] | None = None) -> PropGraph:
        """Add label columns to the nodes."""
        self.add_node_properties(labels, node_column, order_by)
        self.label_columns += [c for c in labels.columns if c != node_column]
        return self

    def add_node_properties(self, properties: DataFrame, node_column: str, order_by: Sequence[str] | None = None) -> PropGraph:
        self._need_edges()
        new = properties.withColumnRenamed(node_column, "id").withColumn("id", F.col("id" if node_column != "id" else node_column).cast("long"))
        self._nodes_table = self._added(self._nodes_table, self.nodes(), new, ["id"], order_by)
        return self

    def add_edge_relationships(self, relationships: DataFrame, source_column: str, destination_column: str, assume_sorted: bool = False, convert_strings_to_categoricals: bool = True, order_by: Sequence[str] | None = None) -> PropGraph:
        """Add relationship columns to the edges."""
        self.add_edge_properties(relationships, source_column, destination_column, order_by)
        self.relationship_columns += [c for c in relationships.columns if c not in (source_column, destination_column)]
        return self

    def add_edge_properties(self, properties: DataFrame, source_column: str, destination_column: str, order_by: Sequence[str] | None = None) -> PropGraph:
        self._need_edges()
        new = properties.withColumnRenamed(source_column, "src").withColumnRenamed(destination_column, "dst")
        self._edges_table = self._added(self._edges_table, self._edges.select("src", "dst"), new, ["src", "dst"], order_by)
        return self

    graph_add_property = add_node_properties

    # --- reading

    def get_node_labels(self) -> DataFrame:
        if not self.label_columns:
            raise KeyError("the graph has no node labels")
        return self._nodes_table.select("id", *self.label_columns)

    def get_node_attributes(self) -> DataFrame:
        return self._nodes_table if self._nodes_table is not None else self.nodes()

    def get_node_properties(self) -> DataFrame:
        return self.get_node_attributes().drop(*self.label_columns)

    def get_edge_relationships(self) -> DataFrame:
        if not self.relationship_columns:
            raise KeyError("the graph has no edge relationships")
        return self._edges_table.select("src", "dst", *self.relationship_columns)

    def get_edge_attributes(self) -> DataFrame:
        return self._edges_table if self._edges_table is not None else self._edges

    def get_edge_properties(self) -> DataFrame:
        return self.get_edge_attributes().drop(*self.relationship_columns)

    # --- queries

    @staticmethod
    def _within(wanted: dict[str, Sequence]) -> Column:
        out = F.lit(True)
        for name, values in wanted.items():
            out &= F.col(name).isin(list(values))
        return out

    @staticmethod
    def _both_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
        s, d = nodes.select(F.col("id").alias("_s")), nodes.select(F.col("id").alias("_d"))
        return edges.join(s, F.col("src") == F.col("_s"), "left_semi").join(d, F.col("dst") == F.col("_d"), "left_semi")

    def filter_edges(self, node_types: dict[str, Sequence], edge_types: dict[str, Sequence]) -> DataFrame:
        """(src, dst) of the edges whose attributes, and whose endpoints' attributes, are among the given values."""
        edges = self.get_edge_attributes().where(self._within(edge_types)).select("src", "dst")
        return self._both_ends(edges, self.get_node_attributes().where(self._within(node_types))) if node_types else edges

    def subgraph_view(self, filter_node: Callable[[DataFrame], Column] = no_filter, filter_edge: Callable[[DataFrame], Column] = no_filter) -> DiGraph:
        """The directed graph, without attributes, of the edges that pass.

        With an edge filter an edge needs both endpoints kept; without one, either endpoint is enough.
        """
        nodes = self.get_node_attributes()
        kept = nodes.where(filter_node(nodes)).select("id")
        table = self.get_edge_attributes()
        edges = table.where(filter_edge(table)).select("src", "dst")
        if filter_edge is not no_filter:
            found = self._both_ends(edges, kept) if filter_node is not no_filter else edges
        elif filter_node is not no_filter:
            ends = kept.select(F.col("id").alias("_k"))
            from_kept = edges.join(ends, F.col("src") == F.col("_k"), "left_semi")
            to_kept = edges.join(ends, F.col("dst") == F.col("_k"), "left_semi")
            found = from_kept.unionAll(to_kept)
        else:
            found = edges
        return DiGraph().add_edges_from(found)

    @staticmethod
    def _having(rows: DataFrame, keys: list[str], columns: list[str], wanted: Sequence[str], op: str) -> DataFrame:
        """The keys whose values over ``columns`` hold all or any of ``wanted``."""
        if op not in ("and", "or"):
            raise ValueError("op is 'and' or 'or'")
        wanted = list(dict.fromkeys(wanted))
        long = rows.select(*keys, F.explode(F.array(*(F.col(c).cast("string") for c in columns))).alias("_v")).where(F.col("_v").isin(wanted))
        grouped = long.groupBy(*keys).agg(F.count_distinct("_v").alias("_n"))
        return grouped.where(F.col("_n") >= (len(wanted) if op == "and" else 1)).select(*keys)

    def query_labels(self, labels: Sequence[str], op: str = "and") -> DataFrame:
        """(id) of the nodes that have all (and) or any (or) of the labels."""
        return self._having(self.get_node_labels(), ["id"], self.label_columns, labels, op)

    def query_relationships(self, relationships: Sequence[str], op: str = "and") -> DataFrame:
        """(src, dst) of the edges that have all or any of the relationships."""
        return self._having(self.get_edge_relationships(), ["src", "dst"], self.relationship_columns, relationships, op)

    @staticmethod
    def _compared(table: DataFrame, column: str, value: object, op: str) -> DataFrame:
        if column not in table.columns:
            raise KeyError(f"no column {column!r}")
        kind = table.schema[column].dataType
        allowed = {"contains", "==", "<>"} if isinstance(kind, StringType) else {"==", "<>"} if isinstance(kind, BooleanType) else set(OPS) - {"contains"}
        if op not in allowed:
            raise ValueError(f"{op!r} isn't for {kind.simpleString()} columns")
        return table.where(OPS[op](F.col(column), value))

    def query_node_properties(self, column: str, value: object, op: str = "<") -> DataFrame:
        return self._compared(self.get_node_attributes(), column, value, op).select("id")

    def query_edge_properties(self, column: str, value: object, op: str = "<") -> DataFrame:
        return self._compared(self.get_edge_attributes(), column, value, op).select("src", "dst")

    def one_path(self, labels: Sequence[str], relationships: Sequence[str], lbl_op: str = "and", rel_op: str = "and") -> DataFrame:
        """(src, dst) of the edges that pass the relationship query and whose two endpoints pass the label query."""
        return self._both_ends(self.query_relationships(relationships, rel_op), self.query_labels(labels, lbl_op))
