"""JSON trees of unknown depth as VARIANT: a walk level by level, each level stored, and trees rewritten from their leaves up. Nothing runs in Python.

A node's path holds its place among its parent's children at each level, so paths sort as a walk in depth goes. Fields of an object come in the order of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

PLAIN_PATH = "array<int>"


def fields(node: Column) -> Column:
    """An object's fields as a map, else null."""
    return F.try_variant_get(node, "$", "map<string,variant>")


def items(node: Column) -> Column:
    """An array's items, else null."""
    return F.try_variant_get(node, "$", "array<variant>")


def is_text(node: Column) -> Column:
    return F.coalesce(F.schema_of_variant(node) == "STRING", F.lit(False))


def text(node: Column) -> Column:
    """A string's text, else null."""
    return F.when(is_text(node), F.try_variant_get(node, "$", "string"))


def number(node: Column) -> Column:
    """A number, else null."""
    return F.when(F.schema_of_variant(node).rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(node, "$", "double"))


def descend(rows: DataFrame, keys: list[str], tree: str, deepest: int, follow=None, strings: bool = False) -> DataFrame:
    """keys, path, name and node of each object and array of the trees, to a depth; name is the field that holds it (null in an array). follow(name, node) says which children
    to visit. strings: strings of JSON in arrays are read too. Each level is a stored table; the walk ends where no child is left."""
    holds = lambda node: fields(node).isNotNull() | items(node).isNotNull()
    level = stored(rows.select(*keys, F.array().cast(PLAIN_PATH).alias("path"), F.lit(None).cast("string").alias("name"), F.col(tree).alias("node")).where(holds(F.col("node"))), "tree")
    out = level
    for _ in range(deepest):
        child = lambda name, value: F.struct(name.alias("name"), value.alias("node"))
        read = lambda v: F.when(is_text(v), F.try_parse_json(F.try_variant_get(v, "$", "string"))).otherwise(v) if strings else v
        of_object = F.transform(F.map_entries(fields(F.col("node"))), lambda e: child(e["key"], e["value"]))  # noqa: B023
        of_array = F.transform(items(F.col("node")), lambda v: child(F.lit(None).cast("string"), read(v)))  # noqa: B023
        kids = level.select(*keys, F.col("path").alias("up"), F.posexplode(F.coalesce(of_object, of_array)).alias("pos", "kid")).select(*keys, F.concat("up", F.array("pos")).alias("path"), "kid.name", "kid.node")
        level = stored(kids.where(holds(F.col("node")) & (follow(F.col("name"), F.col("node")) if follow else F.lit(True))), "tree")
        if not level.limit(1).count():
            break
        out = out.union(level)
    return out


#: Parts of names that mark a private field; most items of an array and characters of its strings.
PRIVATE, ITEMS, ITEM_TEXT = r"(?i)prompt|password|token|email|authorization", 20, 120


def _cut(v: Column, most: int) -> Column:
    return F.when(F.length(v) <= most, v).otherwise(F.concat(F.substring(v, 1, most - 1), F.lit("…")))


def _quoted(v: Column) -> Column:
    """A string as JSON."""
    inside = F.to_json(F.array(v))
    return inside.substr(F.lit(2), F.length(inside) - 2)


def redacted(rows: DataFrame, key: str, payload: str, deepest: int = 64) -> DataFrame:
    """key and redacted JSON of each row's payload (a JSON object; else null): private fields go at every depth of objects, links lose their query, titles are cut to 80
    characters, queries to 60, other strings to 300; arrays keep 20 items, whose strings are cut to 120. Objects deeper than `deepest` are left out. Keys must be unique."""
    open_ = lambda name, node: name.isNotNull() & ~name.rlike(PRIVATE) & fields(node).isNotNull()
    nodes = descend(rows.select(key, F.try_parse_json(F.col(payload)).alias("tree")), [key], "tree", deepest, open_).where(fields(F.col("node")).isNotNull())

    def leaf(name: Column, v: Column) -> Column:
        s, low = F.try_variant_get(v, "$", "string"), F.lower(name)
        told = F.when(low.contains("url"), F.substring(F.regexp_replace(s, r"[?#].*$", ""), 1, 200)).when(low.contains("query"), _cut(F.trim(s), 60)).when(low.contains("title"), _cut(F.trim(s), 80)).otherwise(_cut(s, 300))
        # a title or query of blanks is left out
        kept = F.when(low.contains("url") | ~(low.contains("query") | low.contains("title")) | (F.trim(s) != ""), _quoted(told))
        some = F.transform(F.slice(items(v), 1, ITEMS), lambda x: F.when(is_text(x), _quoted(F.substring(F.try_variant_get(x, "$", "string"), 1, ITEM_TEXT))).otherwise(F.to_json(x)))
        return F.when(is_text(v), kept).when(items(v).isNotNull(), F.concat(F.lit("["), F.array_join(some, ","), F.lit("]"))).otherwise(F.to_json(v))

    own = F.transform(F.filter(F.map_entries(fields(F.col("node"))), lambda e: ~e["key"].rlike(PRIVATE) & fields(e["value"]).isNull()), lambda e: F.struct(e["key"].alias("name"), leaf(e["key"], e["value"]).alias("json")))
    flat = stored(nodes.select(key, "path", "name", F.size("path").alias("depth"), own.alias("own")), "tree")
    depth = flat.agg(F.max("depth")).first()[0]
    below = None
    for level in range(depth if depth is not None else -1, -1, -1):
        here = flat.where(F.col("depth") == level)
        if below is not None:
            here = here.join(below, [key, "path"], "left").withColumn("own", F.concat("own", F.coalesce("more", F.array().cast("array<struct<name:string,json:string>>"))))
        told = F.filter(F.sort_array("own"), lambda f: f["json"].isNotNull())
        json = F.concat(F.lit("{"), F.array_join(F.transform(told, lambda f: F.concat(_quoted(f["name"]), F.lit(":"), f["json"])), ","), F.lit("}"))
        done = stored(here.select(key, "path", "name", json.alias("json")), "tree")
        up = F.slice("path", 1, F.size("path") - 1)
        below = done.groupBy(key, up.alias("path")).agg(F.collect_list(F.struct("name", "json")).alias("more")) if level else done.select(key, F.col("json").alias("redacted"))
    if below is None:
        below = flat.select(key, F.lit(None).cast("string").alias("redacted")).limit(0)
    return rows.select(key).join(below, key, "left")


def structured_products(pages: DataFrame, scripts: Column, deepest: int = 16) -> DataFrame:
    """page_id, place, name, price and json of the products in a page's structured data (scripts: its texts), through arrays and @graph alone: objects whose @type is or holds
    Product. price is the first offer's price or low price. Bad JSON gives none."""
    rows = pages.select("page_id", F.posexplode(scripts).alias("script", "text")).withColumn("tree", F.try_parse_json("text"))
    nodes = descend(rows, ["page_id", "script"], "tree", deepest, lambda name, node: name.isNull() | (name == "@graph"))
    m = fields(F.col("node"))
    kind = F.try_element_at(m, F.lit("@type"))
    product = F.coalesce((text(kind) == "Product") | F.exists(items(kind), lambda t: text(t) == "Product"), F.lit(False))
    offer = F.try_element_at(m, F.lit("offers"))
    offer = F.coalesce(F.try_element_at(items(offer), F.lit(1)), offer)
    amount = lambda k: F.regexp_replace(F.regexp_replace(F.try_variant_get(offer, f"$.{k}", "string"), r"[\s ]", ""), ",", ".").try_cast("double")
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("script", "path")) - 1
    return nodes.where(product).select("page_id", place.alias("place"), text(F.try_element_at(m, F.lit("name"))).alias("name"), F.coalesce(amount("price"), amount("lowPrice")).alias("price"), F.to_json("node").alias("json"))
