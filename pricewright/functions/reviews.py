"""Rules on review texts: ratings, topics, authenticity, limits of an analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import numbers as n
from . import text as t
from .titles import has, part

#: Stems of a topic, what praise of it says, what complaint says.
TOPICS = (
    (("качеств", "прочн"), "Хвалят качество", "Жалуются на качество"), (("удобн", "эргоном"), "Удобен в использовании", "Неудобен в использовании"),
    (("доставк", "привезли", "курьер"), "Хорошая доставка", "Проблемы с доставкой"), (("соответств", "как на фото", "как в описан"), "Соответствует описанию", "Не соответствует описанию"),
    (("батаре", "аккумулятор", "держит заряд"), "Хорошая автономность", "Слабая автономность"), (("экран", "дисплей", "яркост"), "Хороший экран", "Проблемы с экраном"),
    (("камер", "фото", "снимк"), "Хвалят камеру/фото", "Разочарованы камерой/фото"), (("звук", "динамик", "громкост"), "Хороший звук", "Слабый звук"), (("брак", "дефект", "сломал"), None, "Встречаются брак и поломки"),
    (("размер", "маломер", "великоват"), None, "Проблемы с размером"), (("запах",), None, "Неприятный запах"), (("цена", "дорог", "дешев"), "Считают цену оправданной", "Считают цену завышенной"),
)
MOSTLY_GOOD, MOSTLY_BAD, SOME_BAD = "Большинство отзывов положительные", "Преобладает негативный опыт покупателей", "Есть отдельные негативные отзывы"
#: Stems by which a rating is guessed.
BAD_STEMS, GOOD_STEMS = "плох|брак|ужас|не рекоменд|сломал|дефект|вернул|обман", "отличн|супер|рекоменд"
COUNTERFEIT = r"подделк|реплик|не\s*оригинал|неоригинал|\bкопия\b|\bкопии\b|\banalog\b|аналог|1\s*:\s*1|airpro|air\s*pro(?!\s*max\b)|pods\s*max\s*gut|compatible\s*with|совместим(?:ый|ая)?\s+с"
STAR_WORDS = ((5, "пять|5"), (4, "четыре|4"), (3, "три|3"), (2, "два|2"), (1, "одна|одну|1"))


def guessed_rating(x: Column) -> Column:
    low = F.lower(x)
    return F.when(low.rlike(BAD_STEMS), 2).when(low.rlike(GOOD_STEMS), 5).otherwise(4)


def said_rating(x: Column) -> Column:
    """Stars that a text names (1 to 5), or null: 'rating: 4.5', '4/5', number words, star signs."""
    low = F.lower(x)
    named = part(low, r"(?:оценк[аи]|рейтинг|звезд[аы]?|stars?)\s*[:\-]?\s*(\d(?:\.\d)?)", 1).cast("double")
    slashed = part(low, r"\b([1-5])\s*\/\s*5\b", 1).cast("double")
    signs = lambda k: x.contains("⭐" * k)
    words = F.coalesce(*[F.when(has(x, rf"\b(?:{w})\s*звезд") | signs(k), float(k)) for k, w in STAR_WORDS])
    return F.coalesce(F.when(named.between(1, 5), named), slashed, words)


def rating_and_count(x: Column) -> Column:
    """struct(rating, reviews) of a tile's text: '4,8 из 5 · 120 отзывов'."""
    plain = F.translate(x, " ", " ")
    stars = F.coalesce(part(plain, r"(\d+[.,]\d+)\s*(?:из\s*5|★|⭐)", 1), part(plain, r"рейтинг[:\s]*(\d+[.,]\d+)", 1), part(plain, r"(\d+[.,]\d+)\s*(?:из|★|⭐)", 1))
    many = F.regexp_replace(F.coalesce(part(plain, r"(\d[\d\s]*)\s*отзыв", 1), part(plain, r"(\d[\d\s]*)\s*оцен", 1)), r"\s", "").try_cast("bigint")
    return F.struct(n.rating(F.translate(stars, ",", ".").cast("double")).alias("rating"), F.when(many > 0, many).alias("reviews"))


def authenticity(title: Column, header: Column, labelled: Column) -> Column:
    """original where the store says so, not_original by words of copies, else unknown."""
    return F.when(labelled, "original").when(has(F.concat_ws("\n", title, header), COUNTERFEIT), "not_original").otherwise("unknown")


def score_of(text: Column, stars: Column, good=t.PRAISE, bad=t.COMPLAINT) -> Column:
    """A review's score: its stars, else those that it names, else 3 and up to 1.5 by sentiment."""
    return F.coalesce(F.when(stars.between(1, 5), stars.cast("double")), said_rating(text), F.least(F.lit(5.0), F.greatest(F.lit(1.0), 3 + t.sentiment(text, good, bad) * 1.5)))


def analysis(reviews: DataFrame, key: list[str], topics=TOPICS, good=t.PRAISE, bad=t.COMPLAINT, templates=t.TEMPLATES) -> DataFrame:
    """Of each key's reviews (text, stars): rating, shares of good and bad ones, up to five pros and cons, risk of fakes, verdict, reviews. One aggregation, sums before the shuffle."""
    x = F.col("text")
    rows = reviews.select(*key, "text", score_of(x, F.col("stars"), good, bad).alias("score"), t.sentiment(x, good, bad).alias("mood"))
    many = F.count(F.lit(1))
    share = lambda c: F.count(F.when(c, 1)) / many
    low = F.lower(x)
    of = lambda stems: F.coalesce(*[F.when(low.contains(s), F.lit(True)) for s in stems], F.lit(False))
    hits = [F.count(F.when(of(stems) & c, 1)).alias(f"t{k}{name}") for k, (stems, *_) in enumerate(topics) for name, c in (("p", F.col("mood") > 0), ("n", F.col("mood") < 0))]
    sums = rows.groupBy(*key).agg(
        many.alias("reviews"), F.round(F.avg("score"), 1).alias("rating"), share(F.col("score") >= 4).alias("good"), share(F.col("score") <= 2.5).alias("bad"), F.count(F.when(F.col("mood") > 0.2, 1)).alias("praise"),
        F.count(F.when(F.col("mood") < -0.2, 1)).alias("complaints"), F.avg(F.length("text")).alias("length"), share(of(templates)).alias("templates"), (F.count_distinct(F.lower(F.substring("text", 1, 40))) / many).alias("starts"), *hits,
    )
    c = F.col
    pros = F.array_compact(F.array(*[F.when(c(f"t{k}p") > c(f"t{k}n"), F.lit(pro)) for k, (_, pro, _) in enumerate(topics) if pro]))
    cons = F.array_compact(F.array(*[F.when((c(f"t{k}n") >= c(f"t{k}p")) & (c(f"t{k}n") > 0), F.lit(con)) for k, (*_, con) in enumerate(topics)]))
    pros = F.when((F.size(pros) == 0) & (c("praise") > c("complaints")), F.array(F.lit(MOSTLY_GOOD))).otherwise(F.slice(pros, 1, 5))
    cons = F.when((F.size(cons) == 0) & (c("complaints") > c("praise")), F.array(F.lit(MOSTLY_BAD))).when((F.size(cons) == 0) & (c("complaints") > 0), F.array(F.lit(SOME_BAD))).otherwise(F.slice(cons, 1, 5))
    risk = F.when(c("reviews") < 3, "medium").when((c("length") < 60) & (c("templates") > 0.5), "high").when((c("starts") < 0.5) | (c("templates") > 0.35), "medium").otherwise("low")
    return sums.withColumn("pros", pros).withColumn("cons", cons).withColumn("risk", risk).withColumn("verdict", verdict(c("rating"), F.col("risk"), c("bad"), c("good"))).select(
        *key, "reviews", "rating", "good", "bad", "pros", "cons", "risk", "verdict"
    )


def verdict(rating: Column, risk: Column, bad: Column, good: Column) -> Column:
    return (
        F.when(risk == "high", "not_recommended").when((rating >= 4.3) & (risk == "low") & (bad < 0.25), "buy_now").when((rating >= 3.8) & (bad < 0.35), "wait_discount")
        .when((rating < 3.0) | (bad > 0.55), "not_recommended").when((rating >= 3.3) & (good >= bad), "wait_discount").otherwise("not_recommended")
    )


def kept_by(kind: Column, text: Column, stars: Column, photo: Column, age_days: Column) -> Column:
    """Whether a filter keeps a review: negative (3 stars at most, guessed without), with_photo, last_month (unknown age stays), else all."""
    return F.when(kind == "negative", F.coalesce(stars, guessed_rating(text)) <= 3).when(kind == "with_photo", F.coalesce(photo, F.lit(False))).when(kind == "last_month", age_days.isNull() | (age_days <= 30)).otherwise(True)


def clamped(rating: Column, risk: Column, said: Column, pros: Column, cons: Column) -> Column:
    """A model's answer within its limits: 1 to 5 (3 if missing or 0), known words only, five pros and cons at most."""
    five = lambda a: F.slice(F.coalesce(a, F.array().cast("array<string>")), 1, 5)
    stars = F.least(F.lit(5.0), F.greatest(F.lit(1.0), F.when(rating != 0, rating).otherwise(3.0)))
    return F.struct(
        stars.alias("rating"), F.when(risk.isin("low", "medium", "high"), risk).otherwise("medium").alias("risk"), F.when(said.isin("buy_now", "wait_discount", "not_recommended"), said).otherwise("wait_discount").alias("verdict"),
        five(pros).alias("pros"), five(cons).alias("cons"),
    )


def merged(reviews: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of reviews of a key with exactly the same text the first in order; reviews without text go. Summed before the shuffle, so a text that many repeat is one row of each task."""
    rest = [c for c in reviews.columns if c not in (*key, "text")]
    first = reviews.where("text IS NOT NULL").groupBy(*key, "text").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__first"))
    return first.select(*key, "text", "__first.*")
