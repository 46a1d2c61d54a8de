"""Chat, instruction and multiple-choice records from rows; conversions between their forms; splits.

Where the choice of an option, a template or a place is free, a hash of a key decides, so that a run repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..functions.predicates import clause_flags, is_broken, is_negative
from ..functions.vectors import place_at, split_size
from ..storage import written


def messages(*turns: tuple[str, Column]) -> Column:
    return F.array(*(F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in turns))


def prompt(c: Column | str) -> Column:
    """System and user turn of a question; multiple choice asks for the number alone."""
    options = F.array_join(T.options_of(c), "\n")
    choice = F.concat(F.lit(fixed.USER_CHOICE + "질문: "), T.question_of(c), F.lit("\n선택지:\n"), options, F.lit("\n\n답변:"))
    open_ = F.concat(F.lit(fixed.USER_OPEN + "질문: "), T._text(c), F.lit("\n\n답변:"))
    multiple = T.is_multiple_choice(c)
    return messages(("system", F.when(multiple, fixed.SYSTEM_CHOICE).otherwise(fixed.SYSTEM_OPEN)), ("user", F.when(multiple, choice).otherwise(open_)))


def full_question(question: Column, options: list[Column]) -> Column:
    """A question and its options that are not blank as numbered lines; numbers follow the columns."""
    lines = [F.when(T.strip(T._text(o)) != "", F.concat(F.lit(f"{k} "), T.strip(o))) for k, o in enumerate(options, 1)]
    return F.concat_ws("\n", T.strip(T._text(question)), *lines)


def normalize_messages(c: Column) -> Column:
    """Role and trimmed content of turns with a role."""
    turns = F.transform(c, lambda m: F.struct(T._text(m["role"]).alias("role"), T.strip(T._text(m["content"])).alias("content")))
    return F.filter(turns, lambda m: m["role"] != "")


def from_instruction(instruction: Column | str, input_: Column | str, output: Column | str, system: str = fixed.SYSTEM_CONVERT, always_join: bool = False) -> Column:
    """An instruction record as three turns; the input follows the instruction on a new line if there is any."""
    i, n = T.strip(T._text(instruction)), T.strip(T._text(input_))
    joined = F.when(i == "", n).otherwise(F.concat(i, F.lit("\n"), n))
    return messages(("system", F.lit(system.strip())), ("user", F.when(n == "", i).otherwise(joined)), ("assistant", T.strip(T._text(output))))


def convert(df: DataFrame, system: str = fixed.SYSTEM_CONVERT) -> DataFrame:
    """Rows with messages: normalised where there are any, else made of instruction, input and output; other columns stay."""
    has = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    made = from_instruction(has("instruction"), has("input"), has("output"), system)
    if "messages" not in df.columns:
        return df.withColumn("messages", made)
    return df.withColumn("messages", F.when(F.size("messages") > 0, normalize_messages(F.col("messages"))).otherwise(made))


def schema_of(columns: list[str]) -> str:
    """messages, conversations, alpaca or prompt_completion, by the columns there are."""
    for name, needed in (("messages", {"messages"}), ("conversations", {"conversations"}), ("alpaca", {"instruction", "output"}), ("prompt_completion", {"prompt", "completion"})):
        if needed <= set(columns):
            return name
    return "messages"


def seed_messages(kind: Column, question: Column, options: Column, answer: Column) -> Column:
    """A seed row as a question and an answer; multiple choice has its options below the question."""
    multiple = (F.upper(T.strip(T._text(kind))) == "MCQ") & (T.strip(T._text(options)) != "")
    user = F.when(multiple, F.concat(T.strip(T._text(question)), F.lit("\n"), T.strip(T._text(options)))).otherwise(T.strip(T._text(question)))
    return messages(("user", user), ("assistant", T.strip(T._text(answer))))


def rendered(c: Column) -> Column:
    """Messages as plain text, for where no chat template is at hand."""
    return F.array_join(F.transform(c, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"])), "\n")


def law_record(law: Column, article: Column, body: Column) -> Column:
    """Messages that summarise an article: summary, points, exceptions and penalties, source."""
    flags = clause_flags(body)
    points = F.array_join(F.transform(T.bullets(body), lambda b: F.concat(F.lit("- "), b)), "\n")
    answer = F.concat(F.lit("[요약] "), T.summary(body), F.lit("\n\n[핵심포인트]\n"), points, F.lit("\n\n[예외·벌칙] "), F.when(F.size(flags) > 0, F.array_join(flags, " · ")).otherwise(fixed.NO_FLAGS), F.lit("\n[근거] "), law, F.lit(" "), article)
    return messages(("system", F.lit(fixed.SYSTEM_LAW)), ("user", F.concat(F.lit("법령: "), law, F.lit("\n조문: "), article, F.lit("\n\n"), body)), ("assistant", answer))


def law_summary_record(law: Column, article: Column, body: Column) -> Column:
    answer = F.array_join(F.slice(F.split(T.collapse(body), T.SENTENCE_END_LAW), 1, 3), " ")
    user = F.concat(F.lit("법령: "), law, F.lit("\n조문: "), article, F.lit("\n\n다음 조문을 3~5문장으로 요약해 주세요.\n\n"), body)
    return messages(("system", F.lit(fixed.SYSTEM_GENERATE)), ("user", user), ("assistant", answer))


def term_record(term: Column, definition: Column) -> Column:
    answer = F.array_join(F.slice(F.split(T.collapse(definition), T.SENTENCE_END_LAW), 1, 2), " ")
    user = F.concat(F.lit("용어 정의를 2~3문장으로 간결히 설명하세요.\n용어: "), term, F.lit("\n\n원문:\n"), definition)
    return messages(("system", F.lit(fixed.SYSTEM_GENERATE)), ("user", user), ("assistant", answer))


def unbroken(df: DataFrame, *columns: str) -> DataFrame:
    """Rows none of whose named texts holds a broken token."""
    for c in columns:
        df = df.where(~is_broken(c))
    return df


def term_answer(definition: Column, section: Column) -> Column:
    """A definition in four parts: definition, points, examples, contrast, and its source."""
    lines = lambda a: F.array_join(F.transform(a, lambda x: F.concat(F.lit("- "), x)), "\n")
    some = T.examples(definition)
    source = F.when(T._text(section) == "", "TTA 표준").otherwise(F.concat(F.lit("TTA 표준("), section, F.lit(")")))
    return F.concat(
        F.lit("[정의] "), T.definition(definition), F.lit("\n\n[핵심포인트]\n"), lines(T.bullets_three(definition)), F.lit("\n\n[예시] "), F.when(F.size(some) > 0, lines(some)).otherwise(fixed.NO_FLAGS),
        F.lit("\n[주의/대비개념] "), F.coalesce(T.contrast(definition), F.lit(fixed.NO_FLAGS)), F.lit("\n[근거] "), source,
    )


def term_records(terms: DataFrame, form: str, system: str) -> DataFrame:
    """Terms (term, definition, section) as records of one of the four forms, with meta."""
    terms = unbroken(terms, "term", "definition")
    answer, meta = term_answer(F.col("definition"), F.col("section")), F.struct("term", "section").alias("meta")
    user = F.concat(F.lit("용어: "), F.col("term"), F.lit("\n\n원문:\n"), F.col("definition"))
    if form == "alpaca":
        return terms.select(F.lit(system).alias("instruction"), user.alias("input"), answer.alias("output"), meta)
    if form == "prompt_completion":
        body = F.concat(F.lit(system + "\n용어: "), F.col("term"), F.lit("\n원문:\n"), F.col("definition"), F.lit("\n"))
        return terms.select(body.alias("prompt"), answer.alias("completion"), meta)
    return terms.select(messages(("system", F.lit(system)), ("user", user), ("assistant", answer)).alias("conversations" if form == "conversations" else "messages"), meta)


def pick(options: list[str], key: Column, salt: str = "pick") -> Column:
    return F.element_at(F.array(*map(F.lit, options)), T.bucket(len(options), key, salt) + 1)


def define_records(terms: DataFrame, n: int = 1) -> DataFrame:
    """n instruction records a term, each with a template of its own."""
    rows = terms.withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return rows.select(F.concat(pick(fixed.DEFINE_TEMPLATES, F.concat_ws("|", "term", "_n")), F.col("term")).alias("instruction"), F.lit("").alias("input"), F.col("definition").alias("output"))


def distractors(rows: DataFrame, key: str, value: str, n: int = 3, group: str | None = None, seed: int = 5) -> DataFrame:
    """(key, others): n distinct values of other rows, none equal to the row's own nor, with group, of its group.

    The distinct values are numbered around a ring in the order of a hash, those of a group apart; a row takes the
    next ones after its own place, and as many more steps as its own value or group's values take away. A row has
    fewer than n only where there are fewer to have. Rows with a null value get values too; null values are none.
    """
    hashed = lambda *parts: F.md5(F.concat_ws("|", F.lit(str(seed)), *parts).cast("binary"))
    values = rows.where(F.col(value).isNotNull()).select(F.col(value).cast("string").alias("_v"), (F.col(group).cast("string") if group else F.lit("")).alias("_g"))
    values = values.groupBy("_v").agg(F.collect_set("_g").alias("_gs")) if not group else values.groupBy("_v", "_g").count().groupBy("_v").agg(F.array_sort(F.collect_set("_g")).alias("_gs"))
    values = written(values.withColumn("_h", hashed(F.col("_v"))).withColumn("_b", F.conv(F.substring("_h", 1, 4), 16, 10).cast("long")), "values")
    counts = values.groupBy("_b").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # 65,536 rows at most
    counts = counts.select(F.col("_b").alias("_bb"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ring = values.join(F.broadcast(counts), F.col("_b") == F.col("_bb"))
    ring = written(ring.withColumn("_at", F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("_h", "_v")) - 1).select("_at", "_v", "_gs"), "ring")
    total = ring.count()
    if not total:
        return rows.select(key).distinct().limit(0).withColumn("others", F.array().cast("array<string>"))
    asked = rows.select(F.col(key).alias("_key"), F.col(value).cast("string").alias("_own"), (F.col(group).cast("string") if group else F.lit("")).alias("_own_g")).dropDuplicates(["_key"])
    asked = written(asked.withColumn("_from", T.bucket(1 << 30, F.lit(str(seed)), F.col("_key")) % F.lit(total)).withColumn("_have", F.lit(0)), "asked")
    found, start, steps = None, 0, 2 * (n + 2)
    while start < total:  # those that still lack some take twice as many steps
        reach = F.explode(F.sequence(F.lit(start), F.lit(min(total, start + steps) - 1)))
        near = asked.withColumn("_step", reach).withColumn("_place", F.pmod(F.col("_from") + F.col("_step"), F.lit(total)))
        near = near.join(ring, F.col("_place") == F.col("_at")).where(~F.col("_v").eqNullSafe(F.col("_own")))
        if group:
            near = near.where((F.size("_gs") > 1) | ~F.array_contains("_gs", F.coalesce("_own_g", F.lit(""))))
        near = near.withColumn("_k", F.col("_have") + F.row_number().over(Window.partitionBy("_key").orderBy("_step"))).where(F.col("_k") <= n).select("_key", "_k", "_v")
        near = written(near, "others")
        found = near if found is None else found.unionByName(near)
        have = near.groupBy(F.col("_key").alias("_kk")).agg(F.count("*").alias("_new"))
        asked = asked.join(have, F.col("_key") == F.col("_kk"), "left").withColumn("_have", F.col("_have") + F.coalesce("_new", F.lit(0))).drop("_kk", "_new").where(F.col("_have") < n)
        asked = written(asked, "asked")
        if asked.isEmpty():
            break
        start, steps = start + steps, 2 * steps
    lists = found.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_k", "_v"))).alias("_l"))
    return lists.select(F.col("_key").alias(key), F.transform("_l", lambda x: x["_v"]).alias("others"))


def balanced_position(df: DataFrame, n_options: str, order: str) -> DataFrame:
    """Adds position: within rows of as many options, places 1 to n in turn by `order`.

    `order` is cut into ranges at sampled values, and running sums of their counts give the places, so that no task
    sorts all rows of a number of options.
    """
    df = written(df, "rows-to-place")  # read for the cuts, for the counts and for the places
    rows = df.withColumn("_n", F.col(n_options))
    kind = df.schema[order].dataType.simpleString()
    if kind in ("int", "bigint", "smallint", "tinyint"):
        cuts = [] if df.isEmpty() else sorted(set(df.agg(F.percentile_approx(order, [k / 256 for k in range(1, 256)], 10_000)).first()[0] or []))
        part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x < F.col(order))) if cuts else F.lit(0)
    else:
        part = F.lit(0)
    rows = rows.withColumn("_part", part)
    counts = rows.groupBy("_n", "_part").agg(F.count("*").alias("_c"))  # 256 rows at most for each number of options
    earlier = Window.partitionBy("_n").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("_n").alias("_nn"), F.col("_part").alias("_pp"), F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"))
    rows = rows.join(counts, F.col("_n").eqNullSafe(F.col("_nn")) & (F.col("_part") == F.col("_pp")))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_n", "_part").orderBy(order)) - 1
    return rows.withColumn("position", F.pmod(place, F.col(n_options)).cast("int") + 1).drop("_n", "_part", "_nn", "_pp", "_before")


def choice_record(question: Column, right: Column, wrong: Column, position: Column, system: str = fixed.SYSTEM_MARK) -> Column:
    """Messages of a multiple-choice question; equal options are one, and the right one stands at the position."""

    def made(x: Column) -> Column:
        lines = F.array_join(F.transform(x["options"], lambda o, i: F.concat((i + 1).cast("string"), F.lit(") "), o)), "\n")
        return messages(("system", F.lit(system)), ("user", F.concat(x["question"], F.lit("\n"), lines, F.lit("\n정답:"))), ("assistant", F.array_position(x["options"], x["right"]).cast("string")))

    options = place_at(F.array_distinct(F.concat(F.array(right), wrong)), right, position)
    return T.let(F.struct(question.alias("question"), right.alias("right"), options.alias("options")), made)


def mix_negatives(ranked: DataFrame, n: int, hard: float = 0.7, seed: int = 6) -> DataFrame:
    """(query_id, doc_id, rank): of each query's ranked neighbours the share `hard` of n from the top, the rest dealt from three times as many below."""
    n_hard = max(1, int(n * hard))
    pool = ranked.where(F.col("rank") <= n_hard + (n - n_hard) * 3)
    soft = Window.partitionBy("query_id", F.col("rank") <= n_hard).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "query_id", "doc_id").cast("binary")), "doc_id")
    pool = pool.withColumn("_k", F.row_number().over(soft))
    return pool.where((F.col("rank") <= n_hard) | (F.col("_k") <= n - n_hard)).select("query_id", "doc_id", "rank")


def rationale(df: DataFrame, keep_others: bool = False) -> DataFrame:
    """Instruction records whose options can be read and whose output is a bare number, with an explanation before the number."""
    instruction, output = T.strip(T._text("instruction")), T.strip(T._text("output"))
    choices = T.parse_choices(instruction)
    number = F.when(output.rlike("^[1-9][0-9]?$"), output.cast("int"))
    chosen = F.element_at(F.filter(choices, lambda x: x["number"].cast("int") == number), -1)["text"]
    said = lambda form: F.replace(F.replace(F.lit(form), F.lit("{number}"), number.cast("string")), F.lit("{text}"), F.coalesce(T.strip(chosen), F.lit("")))
    explained = F.concat(F.when(is_negative(instruction), said(fixed.EXPLAIN_NEGATIVE)).otherwise(said(fixed.EXPLAIN_NORMAL)), F.lit("\n정답: "), number.cast("string"))
    apt = choices.isNotNull() & number.isNotNull()
    rows = df if keep_others else df.where(apt)
    return rows.withColumn("output", F.when(apt, explained).otherwise(F.col("output")))


def conversion_counts(df: DataFrame) -> DataFrame:
    """One row on a table of records of any form: total, with_messages, from_instruction, empty (neither) and with_input."""
    has = lambda c: (T.strip(T._text(c)) != "") if c in df.columns else F.lit(False)
    messages = F.coalesce(F.size("messages") > 0, F.lit(False)) if "messages" in df.columns else F.lit(False)
    made = ~messages & (has("instruction") | has("input") | has("output"))
    return df.agg(F.count("*").alias("total"), F.count_if(messages).alias("with_messages"), F.count_if(made).alias("from_instruction"), F.count_if(~messages & ~made).alias("empty"), F.count_if(has("input")).alias("with_input"))


def split(df: DataFrame, key: str, share: float = 0.9, seed: int = 42) -> DataFrame:
    """Adds part: 'train' for the share of rows first in the order of the MD5 of seed and key, 'val' for the rest.

    With one row, all is train. The cut is found by counts per hash bucket, so that no task sorts all rows.
    """
    rows = df.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))).withColumn("_b", F.conv(F.substring("_h", 1, 4), 16, 10).cast("long"))
    counts = rows.groupBy("_b").agg(F.count("*").alias("_n"))
    w = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # 65,536 rows at most
    counts = counts.select(F.col("_b").alias("_bb"), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_all"))
    rows = rows.join(F.broadcast(counts), F.col("_b") == F.col("_bb"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))
    size = F.when(F.col("_all") <= 1, F.col("_all")).otherwise(split_size(F.col("_all"), share))
    return rows.withColumn("part", F.when(place <= size, "train").otherwise("val")).drop("_h", "_b", "_bb", "_before", "_all")


def attack_rows(objects: DataFrame) -> DataFrame:
    """Objects of a threat catalogue (type, name, description, kill_chain_phases) as (name, text, source, tactic, instruction, output)."""
    rows = objects.where(F.col("type") == "attack-pattern").select(T.strip(T._text("name")).alias("name"), T.strip(T._text("description")).alias("d"), "kill_chain_phases").where("name <> '' AND d <> ''")
    phases = F.filter(F.coalesce("kill_chain_phases", F.array().cast("array<struct<kill_chain_name:string,phase_name:string>>")), lambda p: (p["kill_chain_name"] == "mitre-attack") & (T._text(p["phase_name"]) != ""))
    tactic = F.array_join(F.array_sort(F.array_distinct(F.transform(phases, lambda p: p["phase_name"]))), ",")
    cleaned = T.cut(T.clean_markup("d"))
    return rows.select("name", F.concat("name", F.lit(" — "), cleaned).alias("text"), F.lit("mitre/enterprise-attack").alias("source"), tactic.alias("tactic"), F.concat(F.lit("다음 공격 기법을 설명하시오: "), F.col("name")).alias("instruction"), cleaned.alias("output"))


def exact_dedup(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row, by order, of each key. Pre-aggregates, so that a key with very many rows costs one a task.

    Keys are grouped by their SHA-256, so that long ones are not shuffled beside the rows that hold them.
    """
    columns = df.columns
    firsts = df.groupBy(F.sha2(key.cast("binary"), 256).alias("_key")).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_row"))
    return firsts.select(*(F.col(f"_row.`{c}`").alias(c) for c in columns))


def submission(sample: DataFrame, predictions: DataFrame) -> DataFrame:
    """All IDs of the sample, in order, with the predicted Answer or null."""
    return sample.select("ID").join(predictions.select("ID", "Answer"), "ID", "left").orderBy("ID")


def supervised(rows: DataFrame, most: int = 2048, end_id: int = 2) -> DataFrame:
    """prompt_ids and answer_ids (with end_id) as input_ids, labels masked over the prompt, and attention_mask, cut at `most`."""
    from ..functions.vectors import masked_labels

    answer = F.concat("answer_ids", F.array(F.lit(end_id)))
    ids = F.slice(F.concat("prompt_ids", answer), 1, most)
    keep = [c for c in rows.columns if c not in ("prompt_ids", "answer_ids")]
    return rows.select(*keep, ids.alias("input_ids"), masked_labels(F.col("prompt_ids"), answer, most).alias("labels"), F.array_repeat(F.lit(1), F.size(ids)).alias("attention_mask"))


def law_choice_records(articles: DataFrame, seed: int = 5) -> DataFrame:
    """Questions on what an article (law, article, body) does not hold: three of its items and one of another article's.

    Articles with fewer than three items make none. Columns law, article, messages.
    """
    rows = articles.select("law", "article", "body", F.concat_ws("\u0001", "law", "article").alias("_g"), T.enumerated("body").alias("_items"))
    items = rows.select("_g", F.explode("_items").alias("_item"))
    pool = items.select(F.concat_ws("\u0001", "_g", "_item").alias("_k"), "_item", "_g")
    wrong = distractors(pool, "_k", "_item", 1, group="_g", seed=seed)
    wrong = pool.join(wrong, "_k").groupBy("_g").agg(F.min_by("others", "_k").alias("_other"))
    own = F.slice(F.array_sort(F.transform("_items", lambda x: F.struct(F.xxhash64(F.lit(seed), x).alias("h"), x.alias("x")))), 1, 3)
    made = rows.where(F.size("_items") >= 3).join(wrong, "_g").select("law", "article", "body", F.transform(own, lambda x: x["x"]).alias("_own"), F.element_at("_other", 1).alias("_other"))
    question = F.concat(F.lit("[객관식] 다음 중 <"), F.col("law"), F.lit(" "), F.col("article"), F.lit(">에 포함되지 않는 항목을 고르세요."))
    place = T.bucket(4, F.lit(str(seed)), F.col("law"), F.col("article")) + 1
    return made.select("law", "article", choice_record(question, F.col("_other"), F.col("_own"), place).alias("messages"))


def term_choice_records(terms: DataFrame, seed: int = 5) -> DataFrame:
    """Questions on which definition is a term's (term, definition): its own and three others. Columns term, messages."""
    rows = terms.select("term", T.collapse(F.col("definition")).alias("definition")).withColumn("_k", F.concat_ws("\u0001", "term", "definition"))
    made = rows.join(distractors(rows, "_k", "definition", 3, seed=seed), "_k").where(F.size("others") == 3)
    question = F.concat(F.lit("[객관식] 다음 중 '"), F.col("term"), F.lit("'의 정의로 옳은 것을 고르세요."))
    place = T.bucket(4, F.lit(str(seed)), F.col("_k")) + 1
    return made.select("term", choice_record(question, F.col("definition"), F.col("others"), place).alias("messages"))


def augmented_choices(terms: DataFrame, ranked: DataFrame, n_options: int = 4, hard: float = 0.7, noise: float = 0.15, seed: int = 6) -> DataFrame:
    """Questions from terms (doc_id, term, definition) with near terms as options, of four kinds.

    Given a definition, which term is meant ('term') or is not ('term_negative'); given a term, which definition is
    its own ('definition') or is not ('definition_negative'). In the negative ones the nearest other term's option
    is the answer. ranked is (query_id, doc_id, rank) as neighbours() makes it; of a term's nearest
    max(10, 6 * n_options) mix_negatives makes the pool, equal options are passed over, and what is missing comes
    from other rows by distractors(), so that only in a table with too few different values a term has no question.
    Answers go to places 1 to n_options in turn; definitions are cropped, and their surface is changed a little.
    Columns doc_id, kind, messages.
    """
    n, width = n_options - 1, max(10, 6 * n_options)
    texts = terms.select("doc_id", "term", T.surface_noise(T.crop("definition", F.col("doc_id")), F.col("doc_id"), noise).alias("definition"), F.col("definition").alias("_whole"))
    texts = written(texts, "augmented-texts").where("term <> '' AND definition <> ''")  # not a filter that crops once more
    pool = mix_negatives(ranked.where(F.col("rank") <= width), width, hard, seed).join(texts.select("doc_id", "term", "definition"), "doc_id")
    pool = pool.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "term", "definition"))).alias("_near"))
    rows = texts.join(pool, F.col("doc_id") == F.col("query_id"), "left").drop("query_id")
    spare = {c: distractors(texts, "doc_id", c, n, seed=seed).select(F.col("doc_id").alias(f"_{c}_id"), F.col("others").alias(f"_{c}_spare")) for c in ("term", "definition")}
    for c, others in spare.items():
        rows = rows.join(others, F.col("doc_id") == F.col(f"_{c}_id"), "left").drop(f"_{c}_id")
        near = F.transform(F.coalesce("_near", F.array().cast("array<struct<rank:int,term:string,definition:string>>")), lambda x: x[c])  # noqa: B023
        options = F.array_distinct(F.concat(near, F.coalesce(f"_{c}_spare", F.array().cast("array<string>"))))
        rows = rows.withColumn(f"_{c}_wrong", F.slice(F.filter(options, lambda x: x != F.col(c)), 1, n))  # noqa: B023
    rows = rows.where((F.size("_term_wrong") == n) & (F.size("_definition_wrong") == n)).withColumn("_n", F.lit(n_options))
    rows = balanced_position(rows, "_n", "doc_id")
    place, term, body = F.col("position"), F.col("term"), F.col("definition")
    kinds = {}
    for c, given, asks in (("term", body, fixed.ASK_TERM), ("definition", term, fixed.ASK_DEFINITION)):
        wrong = F.col(f"_{c}_wrong")
        kinds[c] = (F.concat(F.lit(asks[0]), given), F.col(c), wrong)
        kinds[f"{c}_negative"] = (F.concat(F.lit(asks[1]), given), F.get(wrong, F.lit(0)), F.concat(F.array(F.col(c)), F.slice(wrong, 2, n)))
    made = [F.struct(F.lit(kind).alias("kind"), choice_record(question, right, wrong, place).alias("messages")) for kind, (question, right, wrong) in kinds.items()]
    return rows.select("doc_id", F.explode(F.array(*made)).alias("r")).select("doc_id", "r.*")
