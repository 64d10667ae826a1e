"""Corpora of given tables: texts become pages of blocks, orders and their lines become invoices.

Everything but the gathering of an invoice's lines is a column expression of the row; lines are summed before they are
gathered, in one shuffle on the document. A page is a row, so its blocks must fit one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import generate
from . import schemas as S

#: Ends a block while a text is cut; where a given text has it, it is written as ESC and a digit meanwhile, as is ESC.
END, ESC = "\x1e", "\x1f"
_BLANK = r"^[\x20\x09-\x0D]*\z"


def blocks_of(text: Column) -> Column:
    """A text's blocks in order: lines with a bar that follow each other are one block, every other line is one; blank ones are none."""
    marked = text.contains(END) | text.contains(ESC)
    safe = F.when(marked, F.replace(F.replace(text, F.lit(ESC), F.lit(ESC + "1")), F.lit(END), F.lit(ESC + "0"))).otherwise(text)
    cut = F.regexp_replace(safe, r"\n(?=[^|\n]*(?:\n|\z))", END)  # the next line has no bar
    cut = F.regexp_replace(cut, rf"(^|{END})([^|\n{END}]*)\n", f"$1$2{END}")  # this line has none
    blocks = F.filter(F.split(F.coalesce(cut, F.lit("")), END), lambda b: ~b.rlike(_BLANK))
    return F.when(marked, F.transform(blocks, lambda b: F.replace(F.replace(b, F.lit(ESC + "0"), F.lit(END)), F.lit(ESC + "1"), F.lit(ESC)))).otherwise(blocks)


def kind_of(block: Column) -> Column:
    """table (a bar), title (starts with #), equation (an equals sign) or paragraph."""
    return F.when(block.contains("|"), "table").when(block.startswith("#"), "title").when(block.contains("="), "equation").otherwise("paragraph")


def grid_of(block: Column, id_: Column, box: Column) -> Column:
    """The table of a block's bars: a row a line, a cell between bars; rows may be short."""
    lines = F.transform(F.split(block, "\n"), lambda x: F.split(x, r"\|"))
    rows, columns = F.size(lines), F.array_max(F.transform(lines, F.size))
    width, height = box["width"] / columns, box["height"] / rows

    def cell(text: Column, r: Column, c: Column) -> Column:
        own = F.trim(text)
        return F.struct(F.concat(id_, F.lit("-c"), r, F.lit("-"), c).alias("cell_id"), r.alias("row_index"), c.alias("column_index"), F.lit(1).alias("row_span"), F.lit(1).alias("column_span"),
            generate._box(box["x"] + c * width, box["y"] + r * height, width, height).alias("bbox"), own.alias("raw_text"), own.alias("normalized_text"))

    cells = F.flatten(F.transform(lines, lambda x, r: F.transform(x, lambda t, c: cell(t, r, c))))
    return F.struct(rows.alias("rows"), columns.alias("columns"), cells.alias("cells"))


def language_of(name: Column) -> Column:
    """(language, script, direction): names outside the closed list are unknown, in Latin script."""
    tag = generate.script_of(name)
    return tag.withField("language", F.when(name.isin(*S.LANGUAGES), name).otherwise("unknown"))


def text_pages(docs: DataFrame) -> generate.Corpus:
    """A page of each text. docs: document_id, doc_pos, text, category (its language), quality.

    A null or empty text has a page without blocks, and a null category is ``unknown``. Repeated rows give repeated pages. Other columns are ignored.
    """
    rows = docs.select("document_id", "doc_pos", "text", "quality", F.coalesce("category", F.lit("unknown")).alias("category")).select(
        "*", F.lit("dev").alias("split"), F.lit(0).alias("page_pos"), F.lit(0).alias("page_index"), F.concat("document_id", F.lit("-p1")).alias("page_id"),
        F.array(F.lit("given"), "category", F.concat(F.lit("quality:"), "quality")).alias("tags"), generate._checksum(page=F.col("document_id"), text=F.col("text")).alias("checksum"), blocks_of(F.col("text")).alias("given"),
    )
    tag = language_of(F.col("category"))

    def block(text: Column, i: Column) -> Column:
        id_, kind, box = F.concat(F.col("page_id"), F.lit("-b"), i), kind_of(text), generate._box(F.lit(80), 100 + i * 200, F.lit(1000), F.lit(160))
        line = generate._line(F.concat(id_, F.lit("-l")), text, tag, box)
        return generate._block(id_, kind, i, F.array(line), F.when(kind == "equation", text), F.when(kind == "table", grid_of(text, id_, box)))

    return generate._corpus(rows, F.transform("given", block))


def invoices_of(headers: DataFrame, lines: DataFrame, fields: dict[str, str]) -> generate.Corpus:
    """An invoice of each header with its lines, totals and two checks.

    headers: document_id, doc_pos, quality, stated (the stated total, decimal or null) and the columns of ``fields`` (name to value type, in order);
    null values are no fields. lines: document_id, position, label, quantity (text), unit_price, line_total, line_tax (decimals); equal positions
    are ordered by the other columns. A header without lines has totals of 0; lines without a header are left out. A check fails where
    the stated total is missing or another.
    """
    item = F.struct("position", "label", "quantity", "unit_price", "line_total")
    money = "decimal(18,2)"
    bodies = lines.groupBy("document_id").agg(F.array_sort(F.collect_list(item)).alias("items"), F.sum("line_total").cast(money).alias("ht"), F.sum("line_tax").cast(money).alias("tva"))

    def field(name: Column | str, kind: str, value: Column) -> Column:
        return F.struct((F.lit(name) if isinstance(name, str) else name).alias("name"), F.lit(kind).alias("kind"), value.cast("string").alias("value"))

    def of_line(x: Column, i: Column) -> Column:
        at = F.concat(F.lit("lines["), i, F.lit("]."))
        parts = (("label", "string", x.label), ("quantity", "decimal", x.quantity), ("unit_price", "currency", x.unit_price), ("line_total", "currency", x.line_total))
        return F.array(*[field(F.concat(at, F.lit(n)), k, v) for n, k, v in parts])

    none = F.lit(0).cast(money)
    rows = headers.join(bodies, "document_id", "left").withColumns({"ht": F.coalesce("ht", none), "tva": F.coalesce("tva", none)}).withColumn("ttc", (F.col("ht") + F.col("tva")).cast(money))
    given = F.concat(
        F.array(*[field(name, kind, F.col(name)) for name, kind in fields.items()]),
        F.flatten(F.transform(F.coalesce("items", F.array().cast(bodies.schema["items"].dataType)), of_line)),
        F.array(*[field(f"total_{n}", "currency", F.col(n)) for n in ("ht", "tva", "ttc")]),
    )
    same = F.when(F.coalesce(F.col("stated") == F.col("ttc"), F.lit(False)), "pass").otherwise("fail")
    checks = F.array(generate.check("lines_sum_to_ht", F.lit("pass"), "line totals are the net total"), generate.check("ht_plus_tva", same, "net and tax are the stated total"))
    pages = rows.select(
        "*", F.lit("dev").alias("split"), F.lit(0).alias("page_pos"), F.lit(0).alias("page_index"), F.concat("document_id", F.lit("-p1")).alias("page_id"), F.lit("invoice").alias("category"),
        F.array(F.lit("given"), F.lit("invoice"), F.concat(F.lit("quality:"), "quality")).alias("tags"), generate._checksum(page=F.col("document_id")).alias("checksum"),
    )
    return generate.invoices(pages, F.filter(given, lambda g: g["value"].isNotNull()), checks)
