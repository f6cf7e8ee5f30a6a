"""Classification of lines, merging with page elements, and assembly into questions, parts and sub-parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text as rules
from lectern.functions.text import ends_in_bracket, extract, extract_int, strip_marks, trim
from lectern.operators.lines import with_left_margin

MARGIN_TOLERANCE = 5.0
HEADER_Y = 60.0
KINDS = {"line": 0, "image": 1, "drawing": 2, "table": 3}


def is_boilerplate(text: Column, y: Column) -> Column:
    short = F.char_length(text) <= 40  # no other line can be one of these
    return F.startswith(text, F.lit("©")) | short & text.rlike(rules.BLANK_PAGE) | (y < HEADER_Y) & short & text.rlike(rules.PAGE_NUMBER)


def classify_lines(lines: DataFrame) -> DataFrame:
    """Adds ``role, content, question_number, part_label, nested_label, marks, total_marks, option_label, sub_ord``.

    The first rule that fits decides: boilerplate, sub-part, sub-sub-part, question number near the left
    margin, four options in one line (four rows, sub_ord 0 to 3, without marks), one option, body. Lines
    are parted by document once, for the margin and for what follows; patterns are run only on lines whose
    first or last character lets them fit.
    """
    t, first = F.col("_t"), F.substring("_t", 1, 1)
    base = with_left_margin(lines).withColumn("_t", trim(F.col("text")))
    bracket, digit, letter = first == "(", first.between("0", "9"), first.isin(*"ABCD")
    base = base.withColumns(
        {
            "_sub": F.when(bracket, extract(t, rules.SUBPART)),
            "_nested": F.when(bracket, extract(t, rules.SUBSUBPART)),
            "_rest": F.when(digit, trim(extract(t, rules.QUESTION, 2))),
        }
    )
    after_sub = F.when(bracket, trim(extract(t, rules.SUBPART, 2)))
    after_question = F.col("_rest")
    after_embedded = trim(extract(after_question, rules.SUBPART, 2))
    null = F.lit(None).cast("string")
    role = (
        F.when(is_boilerplate(t, F.col("y")), "boilerplate")
        .when(F.col("_sub").isNotNull(), "subpart")
        .when(F.col("_nested").isNotNull(), "subSubpart")
        .when(after_question.isNotNull() & (F.col("x") <= F.col("left_margin") + MARGIN_TOLERANCE), "questionNumber")
        .when((first == "A") & t.rlike(rules.INLINE_OPTIONS), "inline")
        .when(letter & t.rlike(rules.OPTION), "option")
        .otherwise("body")
    )
    told = base.withColumn("_role", role)
    r = F.col("_role")
    content = (
        F.when(r == "subpart", F.coalesce(trim(extract(after_sub, rules.SUBSUBPART, 2)), after_sub))
        .when(r == "subSubpart", trim(extract(t, rules.SUBSUBPART, 2)))
        .when(r == "questionNumber", F.coalesce(trim(extract(after_embedded, rules.SUBSUBPART, 2)), after_embedded, after_question))
        .when(r == "option", trim(extract(t, rules.OPTION, 2)))
        .otherwise(t)
    )
    part = F.when(r == "subpart", F.col("_sub")).when(r == "subSubpart", F.col("_nested")).when(r == "questionNumber", extract(after_question, rules.SUBPART))
    nested = F.when(r == "subpart", extract(after_sub, rules.SUBSUBPART)).when(r == "questionNumber", extract(after_embedded, rules.SUBSUBPART))
    one = F.struct(
        F.lit(0).alias("sub_ord"),
        content.alias("content"),
        F.when(r == "option", extract(t, rules.OPTION)).alias("option_label"),
        F.when(ends_in_bracket(t), extract_int(t, rules.MARKS)).alias("marks"),
        F.when(ends_in_bracket(t), extract_int(t, rules.TOTAL_MARKS)).alias("total_marks"),
    )
    four = F.array(
        *[
            F.struct(F.lit(i).alias("sub_ord"), trim(extract(t, rules.INLINE_OPTIONS, i + 1)).alias("content"), F.lit("ABCD"[i]).alias("option_label"), F.lit(None).cast("int").alias("marks"), F.lit(None).cast("int").alias("total_marks"))
            for i in range(4)
        ]
    )
    rows = told.select(
        *[c for c in lines.columns if c not in ("role", "content")],
        F.when(r.isin("inline", "option"), "body").otherwise(r).alias("role"),
        F.when(r == "questionNumber", extract_int(t, rules.QUESTION)).alias("question_number"),
        F.coalesce(part, null).alias("part_label"),
        F.coalesce(nested, null).alias("nested_label"),
        F.explode(F.when(r == "inline", four).otherwise(F.array(one))).alias("_o"),
    )
    return rows.select("*", "_o.sub_ord", strip_marks(F.col("_o.content")).alias("content"), "_o.option_label", "_o.marks", "_o.total_marks").drop("_o")


EVENT = ["resource_id", "page", "y", "kind", "ord", "sub_ord", "element_id", "role", "content", "question_number", "part_label", "nested_label", "marks", "total_marks", "option_label"]


def merge_events(classified: DataFrame, elements: DataFrame | None = None) -> DataFrame:
    """Lines and elements (``resource_id, page, ord, y, kind, element_id``) of each document in one order.

    ``event_no`` numbers them by page, y, kind (lines, images, drawings, tables) and own order. Pages that
    have elements alone count too.
    """
    lines = classified.withColumns({"kind": F.lit("line"), "element_id": F.lit(None).cast("string")}).select(*EVENT)
    if elements is not None:
        lines = lines.unionByName(elements.withColumn("sub_ord", F.lit(0)), allowMissingColumns=True)
    rank = F.lit(9)
    for kind, n in KINDS.items():
        rank = F.when(F.col("kind") == kind, n).otherwise(rank)
    order = Window.partitionBy("resource_id").orderBy("page", "y", rank, "ord", "sub_ord")
    return lines.withColumn("event_no", F.row_number().over(order))


def locate_events(events: DataFrame) -> DataFrame:
    """Adds the place of each event: ``q, p, s`` (running numbers; 0 is none open) and its option state.

    Running counts replace the state machine: a question number opens a question, a part label a part,
    a nested label or a sub-sub-part line in an open part a sub-part. Events before the first question,
    boilerplate and sub-sub-parts outside a part are dropped. Of a question's body lines before its
    first part, those from the first A on that run A, B, C, D in a row are its options; an unfinished
    run goes back to the text with its labels. All windows share the partitioning by document.
    """
    role = F.col("role")
    flag = lambda c: F.sum(F.when(c, 1).otherwise(0))
    over = lambda *keys: Window.partitionBy(*keys).orderBy("event_no").rowsBetween(Window.unboundedPreceding, 0)
    e = events.withColumn("q", flag(role == "questionNumber").over(over("resource_id"))).where("q > 0")
    opens = (role == "subpart") | (role == "questionNumber") & F.col("part_label").isNotNull()
    e = e.withColumn("p", flag(opens).over(over("resource_id", "q")))
    e = e.where(role.isNull() | (role != "boilerplate") & ((role != "subSubpart") | (F.col("p") > 0)))
    opens_sub = (role == "subSubpart") | role.isin("subpart", "questionNumber") & F.col("nested_label").isNotNull()
    e = e.withColumn("s", flag(opens_sub).over(over("resource_id", "q", "p")))
    e = e.withColumn("s", F.when(F.col("p") > 0, F.col("s")).otherwise(0))
    stem = (role == "body") & (F.col("p") == 0)
    whole = Window.partitionBy("resource_id", "q")
    e = e.withColumn("_k", F.when(stem, flag(stem).over(over("resource_id", "q"))))
    e = e.withColumn("_k", F.col("_k") - F.min(F.when(stem & (F.col("option_label") == "A"), F.col("_k"))).over(whole))
    fits = F.coalesce(F.col("option_label") == F.substring(F.lit("ABCD"), (F.col("_k") + 1).cast("int"), F.lit(1)), F.lit(False))
    near = F.col("_k").between(0, 3)
    run = F.coalesce(F.min(F.when(near & ~fits, F.col("_k"))).over(whole), F.max(F.when(near, F.col("_k") + 1)).over(whole))
    state = F.when(near & (F.col("_k") < run), F.when(run == 4, "option").otherwise("recovered"))
    return e.withColumn("option_state", state).drop("_k")


def question_nodes(located: DataFrame) -> DataFrame:
    """One row per question, part and sub-part:

    ``resource_id, q, p, s, level, number, label, text, marks, pages, options, images, drawings, tables``.
    ``pages`` are an array of numbers, ``options`` of structs of label and text, the rest of element ids;
    empty, never null. The last marks given count; totals go to the question.
    """
    role, state = F.col("role"), F.col("option_state")
    is_line = role.isNotNull()
    deepest = F.when(F.col("s") > 0, 2).when(F.col("p") > 0, 1).otherwise(0)
    e = located.withColumn("_deep", deepest)
    spread = e.withColumn("_level", F.explode(F.sequence(F.lit(0), F.col("_deep"))))
    here = F.col("_level") == F.col("_deep")
    at = lambda c, n: F.when(F.col("_level") >= n, c).otherwise(0)
    own_text = F.when(state == "recovered", F.concat(F.col("option_label"), F.lit(" "), F.col("content"))).otherwise(F.col("content"))
    question_marks = F.when(state.isNotNull(), None).when((role.isin("questionNumber") | (role == "body")) & (F.col("p") == 0), F.when(role == "questionNumber", F.coalesce("total_marks", "marks")).otherwise(F.coalesce("marks", "total_marks"))).otherwise(F.col("total_marks"))
    given = F.when(F.col("_level") == 0, question_marks).when(here, F.col("marks"))
    opener = (F.col("_level") == 0) & (role == "questionNumber")
    label = F.when((F.col("_level") == 1) & role.isin("questionNumber", "subpart"), F.col("part_label")).when(
        F.col("_level") == 2, F.when(role == "subSubpart", F.col("part_label")).when(role.isin("questionNumber", "subpart"), F.col("nested_label"))
    )
    text_items = F.collect_list(F.when(is_line & here & (F.coalesce(state, F.lit("")) != "option"), F.struct("event_no", own_text.alias("text"))))
    page_items = F.transform(F.array_sort(F.collect_list(F.when(is_line, F.struct("event_no", "page")))), lambda x: x["page"])
    option_items = F.transform(F.array_sort(F.collect_list(F.when(here & (state == "option"), F.struct("event_no", F.col("option_label").alias("label"), F.col("content").alias("text"))))), lambda x: F.struct(x["label"].alias("label"), x["text"].alias("text")))
    refs = {k: F.transform(F.array_sort(F.collect_list(F.when(here & (F.col("kind") == k), F.struct("event_no", "element_id")))), lambda x: x["element_id"]) for k in ("image", "drawing", "table")}
    nodes = spread.groupBy("resource_id", "q", at(F.col("p"), 1).alias("p"), at(F.col("s"), 2).alias("s")).agg(
        F.max("_level").alias("_l"),
        F.max(F.when(opener, F.col("question_number"))).alias("number"),
        F.max(label).alias("label"),
        trim(F.array_join(F.transform(F.array_sort(text_items), lambda x: x["text"]), " ")).alias("text"),
        F.max_by(given, F.when(given.isNotNull(), F.col("event_no"))).alias("marks"),
        F.array_distinct(page_items).alias("pages"),
        option_items.alias("options"),
        *[v.alias(f"{k}s") for k, v in refs.items()],
    )
    level = F.when(F.col("_l") == 0, "question").when(F.col("_l") == 1, "part").otherwise("subpart")
    return nodes.select("resource_id", "q", "p", "s", level.alias("level"), "number", "label", "text", "marks", "pages", "options", "images", "drawings", "tables")


def build_questions(lines: DataFrame, elements: DataFrame | None = None) -> DataFrame:
    return question_nodes(locate_events(merge_events(classify_lines(lines), elements)))


def nested_questions(nodes: DataFrame) -> DataFrame:
    """The nodes as one nested record per question, parts and sub-parts in order."""
    subs = nodes.where("level = 'subpart'").groupBy("resource_id", "q", "p").agg(F.array_sort(F.collect_list(F.struct("s", "label", "text", "marks", "pages", "images", "drawings", "tables"))).alias("sub_parts"))
    parts = nodes.where("level = 'part'").join(subs, ["resource_id", "q", "p"], "left")
    empty = F.array().cast(subs.schema["sub_parts"].dataType)
    parts = parts.groupBy("resource_id", "q").agg(F.array_sort(F.collect_list(F.struct("p", "label", "text", "marks", "pages", "images", "drawings", "tables", F.coalesce("sub_parts", empty).alias("sub_parts")))).alias("parts"))
    return nodes.where("level = 'question'").drop("p", "s", "level", "label").join(parts, ["resource_id", "q"], "left")
