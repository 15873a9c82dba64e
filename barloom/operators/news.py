"""News texts as rows per stock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import encode_b64
from .joins import dedup_first, news_code_join
from .ranking import first_items

#: Patterns of dates, lines and stock tokens in the files.
DATE = r"(202[23456])[.\-_\s]*(\d{2})[.\-_\s]*(\d{2})"
TOKEN = r"([가-힣a-zA-Z0-9&\s]+)\s*\(([+-]?\d+\.?\d*\%)\)"
SKIPPED = ("---", "date:", "created:")
CATEGORY = ("### ", "**<", "< ")
NO_NEWS = "뉴스 없음"

#: Tokens of a page: a comment, a script or style as a whole, a tag, text, or a '<' that begins none of them.
PAGE_TOKEN = r"""(?is)<!--.*?(?:-->|\z)|<(?:script|style)\b[^>]*>.*?(?:</(?:script|style)\s*>|\z)|<[a-z/!?](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^<]+|<"""
ATTRIBUTE = r"""[^\s"'>/=<]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""
REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": "\u00a0", "&amp;": "&"}


def any_start(c: Column, starts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for s in starts:
        out |= c.startswith(s)
    return out


def news_dates(files: DataFrame) -> DataFrame:
    """news_date from the file's name, else from its first 600 characters; files without one drop out."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    dashed = lambda c: F.nullif(F.concat_ws("-", *(F.nullif(F.regexp_extract(c, DATE, i), F.lit("")) for i in (1, 2, 3))), F.lit(""))
    return files.withColumn("news_date", F.coalesce(dashed(name), dashed(F.substring("text", 1, 600)))).where("news_date is not null")


def news_lines(files: DataFrame) -> DataFrame:
    """Path, news_date, pos, kind (category, header, body) and line; skipped lines drop out."""
    lines = files.select("path", "news_date", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    line = F.regexp_replace("raw", r"^\s+|\s+$", "")
    kind = F.when((line == "") | any_start(line, SKIPPED), "skip").when(any_start(line, CATEGORY), "category").when(line.startswith("#### ") | line.startswith("●") | (line.startswith("**") & line.contains("%")), "header").otherwise("body")
    return lines.select("path", "news_date", "pos", kind.alias("kind"), line.alias("line")).where("kind <> 'skip'")


def bare(line: Column, marks: tuple[str, ...]) -> Column:
    for m in marks:
        line = F.replace(line, F.lit(m), F.lit(""))
    return F.trim(line)


def news_blocks(lines: DataFrame, compat: bool = False) -> DataFrame:
    """Path, news_date, block, category, header, text of each header and the body below it.

    The category is that at the header; compat=True takes the last one before the next header.
    """
    order = Window.partitionBy("path").orderBy("pos")
    category = F.when(F.col("kind") == "category", bare(F.col("line"), ("### ", "**<", ">", "<")))
    marked = lines.withColumns({"block": F.sum((F.col("kind") == "header").cast("int")).over(order), "category": F.last(category, ignorenulls=True).over(order)}).where("block > 0")
    at = F.max_by("category", F.when(F.col("kind") == "header", F.col("pos")))
    chosen = F.max_by("category", "pos") if compat else at
    body = F.array_sort(F.collect_list(F.when(F.col("kind") == "body", F.struct("pos", "line"))))
    grouped = marked.groupBy("path", "news_date", "block").agg(chosen.alias("category"), F.max(F.when(F.col("kind") == "header", F.col("line"))).alias("header"), body.alias("b"))
    text = F.array_join(F.transform("b", lambda x: x["line"]), "\n")
    return grouped.select("path", "news_date", "block", F.coalesce("category", F.lit("")).alias("category"), bare(F.col("header"), ("#### ", "●", "**")).alias("header"), text.alias("text"))


def news_tokens(blocks: DataFrame) -> DataFrame:
    """A row (token: its place) for each 'name (+n%)' of a header; without one the text before '(' and an empty rate."""
    names, rates = (F.regexp_extract_all("header", F.lit(TOKEN), i) for i in (1, 2))
    found = F.arrays_zip(names.alias("n"), rates.alias("r"))
    alone = F.array(F.struct(F.element_at(F.split("header", r"\("), 1).alias("n"), F.lit("").alias("r")))
    rows = blocks.select("*", F.posexplode(F.when(F.size(names) > 0, found).otherwise(alone)).alias("token", "t"))
    return rows.withColumns({"stock_name": F.regexp_replace("t.n", r"^\s+|\s+$", ""), "rate": F.col("t.r")}).drop("t")


def news_items(files: DataFrame, names: DataFrame, aliases: DataFrame, encode: bool = False) -> DataFrame:
    """Items per stock code, each (date, start of title) once, from whole files."""
    blocks = news_blocks(news_lines(news_dates(files))).withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", "")).where(F.length("text") >= 5)
    items = news_code_join(news_tokens(blocks), names, aliases)
    items = items.withColumns({"title": F.substring(F.element_at(F.split("text", "\n"), 1), 1, 80), "content": F.substring("text", 1, 600)})
    items = dedup_first(items.withColumn("__t", F.substring("title", 1, 30)), ["code", "news_date", "__t"], ["path", "block", "token"]).drop("__t")
    if encode:
        items = items.withColumns({"title": encode_b64(F.col("title")), "content": encode_b64(F.col("content"))})
    return items.select("code", "news_date", "stock_name", "category", "rate", "title", "content")


def news_per_year(items: DataFrame) -> DataFrame:
    return items.groupBy(F.substring("news_date", 1, 4).alias("year")).agg(F.count("*").alias("n"))


def page_tokens(html: Column) -> Column:
    """A page as its comments, scripts and styles, tags and texts, in order; quoted attribute values may hold '>'."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(PAGE_TOKEN), 0)


def attribute_of(tag: Column, name: str) -> Column:
    """The value of an attribute of a tag token; the first counts, null without one."""
    found = F.filter(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), 0), lambda a: F.lower(F.regexp_extract(a, r"^[^\s=]+", 0)) == name.lower())
    value = F.regexp_replace(F.try_element_at(found, F.lit(1)), r"^[^=]*=\s*", "")
    return F.when(value.rlike("^[\"']"), F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def plain(text: Column) -> Column:
    """Trimmed text with its common character references decoded."""
    for name, char in REFERENCES.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.trim(text)


def headlines_from_pages(pages: DataFrame, css_class: str = "", n: int = 5, tag: str = "a", attribute: str | None = None) -> DataFrame:
    """Headlines, of the elements of a tag and class (empty: any) on each page.

    Without an attribute name they are the first n texts that aren't empty, else that attribute's values on the first
    n elements, as far as they have it. Marks in comments, scripts, styles and attribute values don't
    count. A class fits as a whole word. Elements nest, but an anchor ends where the next one
    begins; one that never ends goes on to the end of the page. A null page has none.

    One pass over the tokens carries the depth in the element, its text so far and the headlines.
    """
    if not tag.isalnum():
        raise ValueError(f"not a tag: {tag}")
    tokens = page_tokens(F.col("html"))
    opens = lambda t: t.rlike(rf"(?i)^<{tag}[\s/>]")
    closes = lambda t: t.rlike(rf"(?i)^</{tag}[\s/>]")
    fits = lambda t: F.coalesce(F.array_contains(F.split(attribute_of(t, "class"), r"\s+"), css_class), F.lit(False)) if css_class else F.lit(True)
    if attribute is not None:
        some = first_items(F.filter(tokens, lambda t: F.when(opens(t), fits(t)).otherwise(False)), n)
        return pages.withColumn("headlines", F.filter(F.transform(some, lambda t: plain(attribute_of(t, attribute))), lambda v: v != ""))

    def state(depth: Column | int, text: Column, kept: Column) -> Column:
        return F.struct((F.lit(depth) if isinstance(depth, int) else depth).alias("depth"), text.alias("text"), kept.alias("kept"))

    nothing = F.lit("")

    def ended(s: Column) -> Column:
        return F.when((s["depth"] == 0) | (plain(s["text"]) == ""), s["kept"]).otherwise(F.concat(s["kept"], F.array(plain(s["text"]))))

    def step(s: Column, t: Column) -> Column:
        begun = F.when(fits(t), state(1, nothing, ended(s))).otherwise(state(0, nothing, ended(s)))
        deeper = begun if tag.lower() == "a" else state(s["depth"] + 1, s["text"], s["kept"])
        inside = (
            F.when(opens(t), deeper)
            .when(closes(t), F.when(s["depth"] == 1, state(0, nothing, ended(s))).otherwise(state(s["depth"] - 1, s["text"], s["kept"])))
            .when(t.rlike("^<[a-zA-Z/!?]"), s)
            .otherwise(state(s["depth"], F.concat(s["text"], t), s["kept"]))
        )
        outside = F.when(opens(t), begun).otherwise(s)
        return F.when(F.size(s["kept"]) >= n, s).when(s["depth"] > 0, inside).otherwise(outside)

    start = state(0, nothing, F.array().cast("array<string>"))
    return pages.withColumn("headlines", first_items(F.aggregate(tokens, start, step, ended), n))


def daily_issues(picks: DataFrame, headlines: DataFrame) -> DataFrame:
    """today's picks with their headlines and a summary text."""
    joined = picks.where(F.coalesce("elapsed_days", F.lit(-1)) == 0).join(headlines.select("code", "headlines"), "code", "left")
    some = F.coalesce("headlines", F.array().cast("array<string>"))
    return joined.select(F.col("scan_date").alias("issue_date"), "code", F.bround("rate", 2).alias("rate"), F.when(F.size(some) > 0, F.array_join(some, " / ")).otherwise(NO_NEWS).alias("summary"), some.alias("headlines"))
