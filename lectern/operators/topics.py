"""Topics of questions by keyword scores."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The keywords of each topic of the physics syllabus, in order.
PHYSICS_KEYWORDS: dict[str, list[str]] = {
    "Motion, forces and energy": [
        "speed", "velocity", "acceleration", "distance-time", "speed-time", "mass", "weight", "density", "resultant force", "newton",
        "momentum", "moment", "pressure", "work done", "kinetic energy", "potential energy", "gravitational", "power", "efficiency",
        "hooke", "spring", "elastic", "scalar", "vector",
    ],
    "Thermal physics": [
        "particle", "kinetic particle theory", "brownian motion", "solid", "liquid", "gas", "evaporation", "condensation", "melting",
        "boiling", "freezing", "thermal expansion", "specific heat capacity", "specific latent heat", "conduction", "convection",
        "thermal radiation", "infrared", "temperature", "thermometer", "absolute zero", "kelvin",
    ],
    "Waves": [
        "wave", "wavelength", "frequency", "amplitude", "wave speed", "transverse", "longitudinal", "reflection", "refraction",
        "diffraction", "lens", "converging", "diverging", "principal axis", "principal focus", "real image", "virtual image",
        "critical angle", "total internal reflection", "electromagnetic spectrum", "ultraviolet", "x-ray", "microwave", "sound wave",
        "echo", "ultrasound",
    ],
    "Electricity and magnetism": [
        "current", "charge", "coulomb", "circuit", "resistor", "resistance", "potential difference", "voltage", "e.m.f.",
        "electromotive force", "ammeter", "voltmeter", "series circuit", "parallel circuit", "magnetic field", "magnet",
        "electromagnet", "solenoid", "transformer", "generator", "electric motor", "induction", "static electricity", "insulator",
        "conductor", "fuse",
    ],
    "Nuclear physics": [
        "atom", "nucleus", "nuclide", "proton", "neutron", "electron", "isotope", "radioactive", "radioactivity", "radiation", "alpha",
        "beta", "gamma", "half-life", "nuclear equation", "decay", "nuclear fission", "nuclear fusion", "geiger",
    ],
    "Space physics": [
        "earth", "sun", "moon", "solar system", "planet", "orbit", "satellite", "star", "galaxy", "universe", "light-year", "red-shift",
        "big bang", "gravitational field",
    ],
}

WORD = "[A-Za-z0-9_]"


def keyword_pattern(keyword: str) -> str:
    """Between ASCII word edges, with an optional plural s for a single word.

    Written with lookarounds, as Java's word edge is a Unicode one. An edge is where a word character and
    another meet, so a keyword that ends in a full stop needs a word character after it.
    """
    edge = lambda inside, before: f"(?<!{WORD})" if before and inside else f"(?<={WORD})" if before else f"(?!{WORD})" if inside else f"(?={WORD})"
    plain = re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", keyword)
    is_word = lambda c: re.match(WORD, c) is not None
    start, end = edge(is_word(keyword[0]), True), edge(is_word(keyword[-1]), False)
    if " " in keyword:
        return start + plain + end
    return f"{start}(?:{plain}s{edge(True, False)}|{plain}{end})"


def _forms(keyword: str) -> list[str]:
    """The words that a keyword of one plain word matches; none for others, which need their pattern."""
    return [keyword, keyword + "s"] if re.fullmatch(f"{WORD}+", keyword) and keyword == keyword.lower() else []


def with_words(questions: DataFrame, keywords: list[str]) -> DataFrame:
    """Adds ``_low``, the lower-cased text, and ``_words``, which of the keywords' plain words occur in it.

    A text is split once, and its words meet all keywords in one hashed intersection, however many there are.
    """
    forms = sorted({x for k in keywords for x in _forms(k)})
    low = questions.withColumn("_low", F.lower("text"))
    known = F.array(*map(F.lit, forms)) if forms else F.array().cast("array<string>")
    return low.withColumn("_words", F.array_intersect(F.split("_low", f"{WORD.replace('[', '[^')}+", -1), known))


def matched_keywords(keywords: list[str]) -> Column:
    """The keywords that occur in a text (see ``with_words``), in their order. Patterns are constants, and run only where their words occur."""
    low, words = F.col("_low"), F.col("_words")

    def occurs(k: str) -> Column:
        if _forms(k):
            return F.array_contains(words, k) | F.array_contains(words, k + "s")
        return F.contains(low, F.lit(k.lower())) & low.rlike(keyword_pattern(k))

    return F.array_compact(F.array(*[F.when(occurs(k), F.lit(k)) for k in keywords])) if keywords else F.array().cast("array<string>")


def keyword_scores(questions: DataFrame, topics: dict[str, list[str]] | None = None) -> DataFrame:
    """``resource_id, question, text`` -> a row for each topic: ``topic_no, topic, matched, score``.

    Topics are expanded in the row; nothing is shuffled.
    """
    topics = PHYSICS_KEYWORDS if topics is None else topics
    each = [F.struct(F.lit(i).alias("topic_no"), F.lit(t).alias("topic"), matched_keywords(k).alias("matched")) for i, (t, k) in enumerate(topics.items(), 1)]
    kind = "array<struct<topic_no:int,topic:string,matched:array<string>>>"
    read = with_words(questions, [k for ks in topics.values() for k in ks])
    rows = read.select("resource_id", "question", F.explode(F.array(*each).cast(kind)).alias("t"))
    return rows.select("resource_id", "question", "t.*").withColumn("score", F.size("matched"))


def assign_topics(questions: DataFrame, topics: dict[str, list[str]] | None = None) -> DataFrame:
    """The topic of each question: ``resource_id, question, topic_no, topic, matched``.

    The best score decides; a best score of 0 or a tie leaves the question unclassified, with null topic
    and no keywords. Scores of a row are compared within the row.
    """
    topics = PHYSICS_KEYWORDS if topics is None else topics
    kind = "array<struct<score:int,topic_no:int,topic:string,matched:array<string>>>"
    found = [F.struct(F.size(m := matched_keywords(k)).alias("score"), F.lit(i).alias("topic_no"), F.lit(t).alias("topic"), m.alias("matched")) for i, (t, k) in enumerate(topics.items(), 1) if k]
    read = with_words(questions, [k for ks in topics.values() for k in ks])
    scored = read.withColumn("_t", F.array(*found).cast(kind)).withColumn("_best", F.array_max(F.transform("_t", lambda x: x["score"])))
    lead = F.filter("_t", lambda x: (x["score"] == F.col("_best")) & (x["score"] > 0))
    told = scored.withColumn("_lead", F.when(F.size(lead) == 1, F.get(lead, 0)))
    return told.select("resource_id", "question", "_lead.topic_no", "_lead.topic", F.coalesce("_lead.matched", F.array().cast("array<string>")).alias("matched"))


def best_by_score(scores: DataFrame) -> DataFrame:
    """The same from rows of scores, by window, for scores that come as a table."""
    w = Window.partitionBy("resource_id", "question")
    best = scores.withColumn("_rank", F.rank().over(w.orderBy(F.desc("score"))))
    lead = best.where("_rank = 1").withColumn("_n", F.count("*").over(w))
    return lead.where("_n = 1 and score > 0").select("resource_id", "question", "topic_no", "topic", "matched")


def assign_syllabus_topics(questions: DataFrame, topics: DataFrame, keywords: dict[str, list[str]] | None = None) -> DataFrame:
    """The syllabus topic of each question: ``resource_id, question, topic_number, topic_name, matched``.

    ``questions(resource_id, syllabus_id, question, text)`` meet the ``topics(syllabus_id, ord, number, name)`` of
    their syllabus, which are reduced to one short list a syllabus first, so the join adds no rows. A topic
    whose name has no keywords scores 0. A best score of 0, a tie, or a syllabus without topics leaves
    the question unclassified, with null topic and no keywords.
    """
    keywords = PHYSICS_KEYWORDS if keywords is None else keywords
    lists = topics.groupBy("syllabus_id").agg(F.array_sort(F.collect_list(F.struct("ord", "number", "name"))).alias("_topics"))
    none = F.array().cast("array<string>")
    known = F.create_map(*[x for name, words in keywords.items() for x in (F.lit(name), matched_keywords(words))])
    scored = with_words(questions, [k for ks in keywords.values() for k in ks]).join(lists, "syllabus_id", "left").withColumn("_known", known)
    each = F.transform("_topics", lambda t: F.struct(t["number"].alias("number"), t["name"].alias("name"), F.coalesce(F.try_element_at(F.col("_known"), t["name"]), none).alias("matched")))
    scored = scored.withColumn("_each", each)
    best = F.array_max(F.transform("_each", lambda t: F.size(t["matched"])))
    lead = F.filter("_each", lambda t: (F.size(t["matched"]) == F.col("_best")) & (F.col("_best") > 0))
    told = scored.withColumn("_best", best).withColumn("_lead", F.when(F.size(lead) == 1, F.get(lead, 0)))
    return told.select("resource_id", "question", F.col("_lead.number").alias("topic_number"), F.col("_lead.name").alias("topic_name"), F.coalesce("_lead.matched", none).alias("matched"))


def question_text(nodes: DataFrame) -> DataFrame:
    """All text of a question, its parts, sub-parts and options, in order: ``resource_id, question, text``."""
    from lectern.functions.text import ordered_join

    own = F.array_join(F.concat(F.array("text"), F.transform("options", lambda o: o["text"])), " ")
    return nodes.groupBy("resource_id", F.col("q").alias("question")).agg(ordered_join(F.collect_list(F.struct("p", "s", own.alias("text")))).alias("text"))
