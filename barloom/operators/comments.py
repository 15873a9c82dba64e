"""Rule comments, their quality flags and repair (Q1-Q7), and report rows (Q8-Q13).

The selection rules and facts follow the reference; the sentences are ours and are
arguments, so a publisher can set their own.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import yes
from ..functions.scalars import code_seed, elapsed_label, format_won, parse_two_date_formats, pick_template, signed_pct
from .joins import theme_join
from .ranking import head_by_pos, top_by_abs_rate

#: Phrases that published texts hold, and what replaces them.
LOW_ZERO, HIGH_ZERO = "전저점(0원)", "전고점(0원)"
PHRASES = (
    ("평균 대비 100% 수준으로", "평균 대비 충분한 수준으로"),
    ("20일 평균 대비 100% 수준으로", "20일 평균 대비 충분한 수준으로"),
    ("평균 대비 100% 거래량과 함께", "평균 대비 증가한 거래량과 함께"),
    ("상단 상단", "상단"),
)
TAILS = ("(+", "으로", ")")
FULL_VOLUME = "거래량은 평균 대비 100%"

#: Our sentences. Volume and return: six cases.
VOLUME_SENTENCES = {
    "surge_up": ["강한 거래를 동반한 상승입니다.", "대량 거래와 함께 크게 올랐습니다."],
    "up": ["거래는 평이하나 크게 올랐습니다.", "상승 탄력이 살아났습니다."],
    "surge_down": ["대량 거래 속에 크게 내렸습니다.", "많은 매물이 나온 하락입니다."],
    "down": ["거래 없이 크게 내렸습니다.", "가격 조정이 이어집니다."],
    "dry": ["거래가 말라 매물이 줄었습니다.", "거래 없는 눌림입니다."],
    "calm": ["뚜렷한 방향이 없습니다.", "숨고르기 구간입니다.", "다음 움직임을 기다립니다."],
}
SUPPORT_SENTENCES = ["지지 {s}, 저항 {r}.", "{s} 위에서 {r} 돌파를 시도합니다.", "{r}까지 여유가 있고 {s}이 받칩니다."]
TRADE_SENTENCES = ["{b} 매수, {x} 손절, 목표 {t}.", "{b} 접근 후 {x} 시 정리, {t} 목표.", "목표 {t}: {b} 매수, {x} 손절."]


def filled(template: Column, facts: dict[str, Column]) -> Column:
    for name, value in facts.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def whole(x: Column) -> Column:
    """x without digits, ties to the even one; numbers of ordinary size take the short way."""
    x = x.cast("double")
    return F.when(F.abs(x) < 1e15, F.rint(x).cast("long").cast("string")).otherwise(F.format_string("%.0f", F.bround(x, 0)))


def won(label: str | Column, x: Column) -> Column:
    return F.concat(F.lit(label) if isinstance(label, str) else label, F.lit("("), whole(x), F.lit("원)"))


def comment_quality_flags(df: DataFrame, comment: str = "comment") -> DataFrame:
    """Q1: the published flags, and a strict one for a price of zero."""
    c = F.coalesce(comment, F.lit(""))
    return df.withColumns({"flag_contains_0won": c.contains("0원"), "flag_zero_won": c.rlike("(?<![0-9,])0원"), "flag_full_volume": c.contains(FULL_VOLUME)})


def grouped_won(text: Column, tail: str) -> Column:
    """'N.0원' before the tail with thousands separators: split there, rewrite the number at each part's end."""
    parts = F.split(text, r"\.0원(?=" + re.escape(tail) + ")")
    last = F.size(parts) - 1

    def joined(p: Column, i: Column) -> Column:
        digits = F.regexp_extract(p, r"(\d+)$", 1)
        head = F.substring(p, F.lit(1), F.length(p) - F.length(digits))
        return F.when(i == last, p).when(digits == "", F.concat(p, F.lit(".0원"))).otherwise(F.concat(head, F.format_number(digits.cast("decimal(38,0)"), 0), F.lit("원")))

    return F.array_join(F.transform(parts, joined), "")


def repair_comment(df: DataFrame, comment: str = "comment", out: str = "repaired", prefixes: bool = False) -> DataFrame:
    """Q2: replace zero lows and highs by estimates from the row's own close, regroup prices, fix phrases."""
    c, close = F.col(comment), F.col("close").cast("double")
    for phrase, label, factor in ((LOW_ZERO, "전저점", 0.88), (HIGH_ZERO, "전고점", 1.12)):
        estimate = (close * factor / 10).cast("long") * 10
        c = F.replace(c, F.lit(phrase), F.concat(F.lit(label + "("), F.format_number(estimate, 0), F.lit("원)")))
    for tail in TAILS:
        c = grouped_won(c, tail)
    for old, new in PHRASES:
        c = F.replace(c, F.lit(old), F.lit(new))
    if prefixes:
        today = F.concat(F.lit("오늘 "), format_won(close), F.lit("원"))
        c = F.when(c.startswith(".0원"), F.concat(today, F.substring(c, 4, 1 << 20))).when(c.startswith("원의 "), F.concat(today, F.lit("의 "), F.substring(c, 4, 1 << 20))).otherwise(c)
    return df.withColumn(out, c)


def clean_generated_text(text: Column) -> Column:
    """Q3: drop guideline tails, English asides and a Latin start; empty without Hangul."""
    for pattern in (r"(?is)Guidelines:.*", r"(?i)No cliches.*", r"(?i)\(Support,?\s*Upward\)", r"\([A-Za-z0-9\s,\->]+\)", r"^[0-9\s,\->\(\)A-Za-z]+"):
        text = F.regexp_replace(text, pattern, "")
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    kept = F.array_join(F.filter(lines, lambda x: (x != "") & ~x.startswith("**") & ~x.startswith("[")), " ")
    return F.when(kept.rlike("[가-힣]"), kept).otherwise("")


def rule_facts(df: DataFrame) -> DataFrame:
    """Q4: kind of day, support, resistance, buy, stop and goal.

    Needs close, low, rate, vol_ratio, ma5, ma20, ma60, ma120, former_peak.
    """
    close, low, peak, rate, ratio = (F.col(c) for c in ("close", "low", "former_peak", "rate", "vol_ratio"))
    kind = F.when((rate >= 5) & (ratio >= 150), "surge_up").when(rate >= 5, "up").when((rate <= -5) & (ratio >= 150), "surge_down").when(rate <= -5, "down").when(ratio <= 50, "dry").otherwise("calm")
    mean = {n: F.col(f"ma{n}") for n in (5, 20, 60, 120)}
    holds = {n: yes((m > 0) & (close >= m)) for n, m in mean.items()}
    tops = {n: yes((m > 0) & (close < m)) for n, m in mean.items()}

    def first(found: list[tuple[Column, str, Column]], label: str | None, price: Column) -> tuple[Column, Column]:
        """Label and price of the first that is found, so that only what is chosen is formatted."""
        label, value = F.lit(label).cast("string"), price.cast("double")
        for hit, name, x in reversed(found):
            label, value = F.when(hit, name).otherwise(label), F.when(hit, x).otherwise(value)
        return label, value

    line = lambda held, *spans: [(held[n], f"{n}일선", mean[n]) for n in spans]
    chosen = {
        "support": first(line(holds, 120, 60, 20, 5), "전저점", low),
        "resistance": first([*line(tops, 5, 20, 60, 120), (yes(peak > close), "전고점", peak)], None, F.lit(None)),
        "buy": first(line(holds, 5, 20, 60), "전저점", low),
        "stop": first([(~holds[5] & holds[20], "20일선", mean[20])], "전저점", low),
    }
    f = df.withColumns({f"__{k}{part}": c for k, both in chosen.items() for part, c in zip(("", "_price"), both, strict=True)})
    text = {k: won(F.col(f"__{k}"), F.col(f"__{k}_price")) for k in chosen}
    text["resistance"] = F.coalesce(text["resistance"], F.lit("상단 이격 저항대"))
    f = f.withColumns({"kind": kind} | text)
    goal = F.when(peak > close * 1.03, won("전고점", peak)).otherwise(F.col("resistance"))
    return f.withColumn("goal", goal).drop(*(c for c in f.columns if c.startswith("__") and c not in df.columns))


def rule_comment(df: DataFrame) -> DataFrame:
    """Q4: volume sentence, support sentence and trade sentence from the facts, chosen by the code's seed.

    Needs code and what rule_facts needs.
    """
    f = rule_facts(df).withColumn("__seed", code_seed(F.col("code"), F.col("close")))
    close, kind, seed = F.col("close"), F.col("kind"), F.col("__seed")
    first = F.lit(None).cast("string")
    for k, v in VOLUME_SENTENCES.items():
        first = F.when(kind == k, pick_template(v, seed)).otherwise(first)
    head = F.concat(format_won(close), F.lit("원("), signed_pct(F.col("rate")), F.lit("), 거래량 "), whole(F.col("vol_ratio")), F.lit("%. "), first)
    second = filled(pick_template(SUPPORT_SENTENCES, seed, 3), {"s": F.col("support"), "r": F.col("resistance")})
    third = filled(pick_template(TRADE_SENTENCES, seed, 7), {"b": F.col("buy"), "x": F.col("stop"), "t": F.col("goal")})
    return f.withColumn("comment", F.concat_ws(" ", head, second, third)).select(*df.columns, "comment")


def rule_comment_candle(df: DataFrame) -> DataFrame:
    """Q5: by the candle's age and the close against the projected 3- or 8-bar mean; needs candle-pick columns."""
    e, close, age = F.col("expected_ma"), F.col("close"), F.col("day_type")
    three, eight = won("3일선", e["ma3"]), won("8일선", e["ma8"])
    text = (
        F.when(age == 0, F.concat(F.lit("당일 기준봉: 거래량 "), F.format_string("%.0f%%", F.bround("vol_ratio", 0)), F.lit(", 내일 "), three, F.lit(" 확인.")))
        .when((age == 1) & (close < e["ma3"]), F.concat(three, F.lit(" 아래: 저항으로 작용합니다.")))
        .when(age == 1, F.concat(F.lit("거래량 "), F.format_string("%.0f%%", F.bround("vol_change_ratio", 0)), F.lit("로 감소, "), three, F.lit(" 지지.")))
        .when((age == 2) & (close < e["ma8"]), F.concat(eight, F.lit(" 아래: 관망합니다.")))
        .when(age == 2, F.concat(F.lit("거래량 "), F.format_string("%.0f%%", F.bround("vol_change_ratio", 0)), F.lit(", "), eight, F.lit(" 지지.")))
        .otherwise("이평선 부근에서 조정을 마쳤습니다.")
    )
    return df.withColumn("commentary", text)


def rule_comment_near_ma(df: DataFrame) -> DataFrame:
    """Q6: which means are near, whether they rise."""
    part = lambda n: F.when(F.col(f"near{n}"), F.concat(won(f"{n}일선", F.col(f"ma{n}")), F.when(F.col(f"trend{n}_up"), " 우상향").otherwise("")))
    text = F.concat(F.col("code"), F.lit(" ("), F.col("ref_date").cast("string"), F.lit(") "), F.concat_ws(", ", F.array_compact(F.array(part(15), part(20)))), F.lit(" 지지."))
    return df.withColumn("commentary", text)


def rule_review(df: DataFrame, min_profit: float = 3.0) -> DataFrame:
    """Q7: hit, adjusting or holding, with what the low touched; needs max_profit, day_return, touches."""
    profit, change = F.col("max_profit"), F.col("day_return")
    text = (
        F.when(profit >= min_profit, F.concat(F.lit("성공: 최고 "), signed_pct(profit, 1)))
        .when(change < 0, F.concat(F.lit("조정: "), signed_pct(change, 1)))
        .otherwise(F.concat(F.lit("유지: "), signed_pct(change, 1)))
    )
    touched = F.concat_ws(", ", F.array_compact(F.array(F.nullif("ma_touches", F.lit("")), F.nullif("extreme_touches", F.lit("")))))
    return df.withColumn("review", F.when(touched == "", text).otherwise(F.concat(text, F.lit(" ("), touched, F.lit(")"))))


def ma_status_rows(feats: DataFrame) -> DataFrame:
    """A row for each mean with a value: projected 5, 10, 20, and 60, 120, 224; role and trend."""
    rows = F.array(*(F.struct(F.lit(f"{n}일선").alias("label"), F.col(f"{'p' if n <= 20 else 'ma'}{n}").alias("value"), F.col(f"t{n}").alias("trend")) for n in (5, 10, 20, 60, 120, 224)))
    out = feats.select("code", "dt", "close", F.explode(rows).alias("r")).where("r.value > 0")
    return out.select("code", "dt", "r.label", F.round("r.value", 6).alias("value"), F.when(F.col("r.value") > F.col("close"), "resistance").otherwise("support").alias("role"), "r.trend")


def dashboard_rows(picks: DataFrame, themes: DataFrame, n: int = 12) -> DataFrame:
    """Q8: the n largest moves per strategy with theme, repaired comment, rounded rate and chart path."""
    top = repair_comment(theme_join(top_by_abs_rate(picks, n, ("scan_date", "strategy")), themes), prefixes=True)
    chart = F.concat(F.lit("charts/"), F.date_format("scan_date", "yyyyMMdd"), F.lit("/"), "code", F.lit(".png"))
    return top.select("scan_date", "strategy", "rank", "code", "name", "close", F.bround("rate", 2).alias("rate"), "pattern", F.col("repaired").alias("comment"), chart.alias("chart"), "category", "subthemes", "detail_theme")


def dashboard_candle_rows(picks: DataFrame, themes: DataFrame, today: Column, n: int = 15) -> DataFrame:
    """Q9: the first n candle picks of a file with label, theme, candle date and elapsed days."""
    day = parse_two_date_formats(F.col("ref_date").cast("string"))
    elapsed, label = elapsed_label(day, today, F.col("candle_class").cast("string"))
    top = theme_join(head_by_pos(picks, n), themes)
    return top.select("scan_date", "rank", "code", "close", F.bround("rate", 2).alias("rate"), label.alias("pattern"), "category", "subthemes", "detail_theme", F.coalesce(day, today).alias("candle_date"), elapsed.alias("elapsed_days"))


def report_rows_picks(picks: DataFrame) -> DataFrame:
    """Q10: numbered rows of a ranked list with names and themes."""
    return picks.select("scan_date", "strategy", "rank", "name", "code", F.col("close").cast("long").alias("close"), signed_pct(F.col("rate")).alias("rate"), "pattern", "themes")


def report_rows_review(review: DataFrame) -> DataFrame:
    """Q11: hits and misses, numbered each, with a short result."""
    side = Window.partitionBy("review_date", "strategy", "hit").orderBy(F.desc("max_profit"), "code")
    return rule_review(review).select("review_date", "strategy", "hit", F.row_number().over(side).alias("no"), "code", signed_pct(F.col("max_profit"), 1).alias("best"), "review")


def report_rows_candle(candles: DataFrame, near: DataFrame) -> DataFrame:
    """Q12: candle picks, then near-mean picks, in one table."""
    label = F.when(F.col("day_type") == 0, "당일").when(F.col("day_type") == 1, "1일차").when(F.col("day_type") == 2, "2일차").otherwise(F.format_string("%d일차", F.col("day_type")))
    a = candles.select("scan_date", F.lit(1).alias("part"), "code", "close", signed_pct(F.col("rate")).alias("rate"), label.alias("day"), F.format_string("%.0f%%", F.bround("vol_ratio", 0)).alias("volume"), F.col("ref_date"))
    b = near.select("scan_date", F.lit(2).alias("part"), "code", "close", signed_pct(F.col("rate")).alias("rate"), F.lit("이평선").alias("day"), F.lit("-").alias("volume"), F.col("ref_date"))
    return a.unionByName(b)


def candle_detail_rows(candles: DataFrame) -> DataFrame:
    """Q13: the facts of a candle pick in flat columns."""
    e = F.col("expected_ma")
    return candles.select("scan_date", "code", "close", "low", "vol_ratio", "former_peak", *(F.round(e[f"ma{n}"], 6).alias(f"ma{n}") for n in (3, 5, 8, 20)), *(e[f"ma{n}_trend"].alias(f"ma{n}_trend") for n in (3, 5, 8, 20)))
