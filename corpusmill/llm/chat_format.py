r"""Chat formatting by schema fingerprint.

A record's nested field paths are hashed; the hash selects a declarative mapping, which reads the record into canonical
turns (role, text). Turns are then written in one template,

    <|im_start|>role\ntext<|im_end|>\n

with control strings of common templates broken inside texts and roles by a backslash after their first character, and
backslashes doubled, so that every text reads back exactly. A run-length mask marks the assistant's texts.

Defined results: null roles and texts are empty; rows that repeat a turn follow each other by role, then text; a record
whose paths no mapping declares, or that is no JSON, has a null layout and null turns; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings that are never left whole inside a text. Fixed values.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_BREAK = r"(<(?=/?s>|\|(?:im_start|im_end|endoftext)\|>)|\[(?=/?INST\])|\\)"
_TURN = r"(?s)<\|im_start\|>((?:\\.|[^\\\n])*+)\n(.*?)<\|im_end\|>\n"

#: Layouts: name, nested field paths as schema_of_variant spells them without types, and SQL over the variant v that gives
#: array<struct<role,text>>.
LAYOUTS = {
    "messages": ("OBJECT<messages: ARRAY<OBJECT<content, role>>>", "transform(variant_get(v, '$.messages', 'array<struct<role:string,content:string>>'), x -> struct(x.role as role, x.content as text))"),
    "conversations": ("OBJECT<conversations: ARRAY<OBJECT<from, value>>>", "transform(variant_get(v, '$.conversations', 'array<struct<from:string,value:string>>'), x -> struct(case x.from when 'human' then 'user' when 'gpt' then 'assistant' else x.from end as role, x.value as text))"),
    "prompt": ("OBJECT<completion, prompt>", "array(struct('user' as role, variant_get(v, '$.prompt', 'string') as text), struct('assistant' as role, variant_get(v, '$.completion', 'string') as text))"),
    "instruction": ("OBJECT<instruction, output>", "array(struct('user' as role, variant_get(v, '$.instruction', 'string') as text), struct('assistant' as role, variant_get(v, '$.output', 'string') as text))"),
    "instruction_input": ("OBJECT<input, instruction, output>", "array(struct('user' as role, concat(variant_get(v, '$.instruction', 'string'), '\\n\\n', variant_get(v, '$.input', 'string')) as text), struct('assistant' as role, variant_get(v, '$.output', 'string') as text))"),
}


def field_paths(v: Column) -> Column:
    """The nested field names of a variant in name order; types are left out."""
    return F.regexp_replace(F.schema_of_variant(v), r": (?:STRING|BIGINT|BOOLEAN|VOID|DOUBLE|FLOAT|DATE|TIMESTAMP|DECIMAL\([0-9, ]+\))", "")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _BREAK, r"$1\\")


def escape_role(role: Column) -> Column:
    return F.regexp_replace(escape(role), "\n", "\\\\\n")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def conversation_records(conversations: DataFrame) -> DataFrame:
    """Rows of turns (conv_id, turn, role, text) to one JSON record for each conversation, in the layout that suits it.

    A user's turn and an assistant's answer make a prompt record, or for every third id an instruction record, with what
    follows the first empty line as its input. Other conversations of odd id hold from/value pairs, those of even id
    role/content pairs. One conversation's turns must fit a task: its digests need them in order.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    one = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    asked, told = F.col("t")[0]["text"], F.element_at("t", -1)["text"]
    pair = (F.size("t") == 2) & (F.col("t")[0]["role"] == "user") & (F.element_at("t", -1)["role"] == "assistant")
    third = F.pmod("conv_id", F.lit(3)) == 1
    cut = F.instr(asked, "\n\n")
    prompt = F.to_json(F.struct(asked.alias("prompt"), told.alias("completion")))
    instruction = F.to_json(F.struct(asked.alias("instruction"), told.alias("output")))
    with_input = F.to_json(F.struct(F.substring(asked, F.lit(1), cut - 1).alias("instruction"), F.substring(asked, cut + 2, F.lit((1 << 31) - 1)).alias("input"), told.alias("output")))
    spoken = F.expr("to_json(struct(transform(t, x -> struct(case x.role when 'user' then 'human' when 'assistant' then 'gpt' else x.role end as from, x.text as value)) as conversations))")
    listed = F.expr("to_json(struct(transform(t, x -> struct(x.role as role, x.text as content)) as messages))")
    safe = F.exists("t", lambda x: x["role"].isin("human", "gpt"))
    record = F.when(pair & third & (cut > 0), with_input).when(pair & third, instruction).when(pair, prompt).when((F.pmod("conv_id", F.lit(2)) == 1) & ~safe, spoken).otherwise(listed)
    return one.select("conv_id", record.alias("record"))


def canonical_turns(records: DataFrame, layouts: dict[str, tuple[str, str]] = LAYOUTS) -> DataFrame:
    """Add to each record (JSON in `record`) its fingerprint, the layout selected by it, and turns array<struct<role,text>>."""
    seen = records.withColumn("v", F.try_parse_json("record")).withColumn("fingerprint", F.xxhash64(field_paths(F.col("v"))))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for name, (paths, sql) in layouts.items():
        same = F.col("v").isNotNull() & (F.col("fingerprint") == F.xxhash64(F.lit(paths)))
        layout, turns = F.when(same, F.lit(name)).otherwise(layout), F.when(same, F.expr(sql)).otherwise(turns)
    tidy = F.transform(turns, lambda x: F.struct(F.coalesce(x["role"], F.lit("")).alias("role"), F.coalesce(x["text"], F.lit("")).alias("text")))
    return seen.select("*", layout.alias("layout"), tidy.alias("turns")).drop("v")


def format_turns(records: DataFrame) -> DataFrame:
    """Add `formatted` and `loss_mask`, runs array<struct<length,in_loss>> over its code points: assistants' texts are in."""
    parts = F.flatten(F.transform("turns", lambda x: F.array(
        F.struct(F.concat(F.lit("<|im_start|>"), escape_role(x["role"]), F.lit("\n")).alias("part"), F.lit(False).alias("in_loss")),
        F.struct(escape(x["text"]).alias("part"), (x["role"] == "assistant").alias("in_loss")),
        F.struct(F.lit("<|im_end|>\n").alias("part"), F.lit(False).alias("in_loss")),
    )))
    cut = records.withColumn("parts", parts)
    mask = F.transform("parts", lambda x: F.struct(F.length(x["part"]).cast("long").alias("length"), x["in_loss"].alias("in_loss")))
    return cut.select("*", F.array_join(F.transform("parts", lambda x: x["part"]), "").alias("formatted"), mask.alias("loss_mask")).drop("parts")


#: Runs of a mask that are read together.
RUNS = 256


def masked_texts(formatted: DataFrame) -> Column:
    """The pieces of `formatted` that `loss_mask` has in the loss, in order.

    Runs are read in blocks: a block is cut from the whole text, a run from its block, so that neither offsets nor texts
    are scanned from the start for every run.
    """
    total = lambda runs: F.aggregate(runs, F.lit(0).cast("long"), lambda a, r: a + r["length"])
    blocks = F.when(F.size("loss_mask") > 0, F.transform(F.sequence(F.lit(0), F.expr(f"(size(loss_mask) - 1) div {RUNS}")), lambda b: F.slice("loss_mask", (b * RUNS + 1).cast("int"), RUNS))).otherwise(F.array().cast("array<array<struct<length:bigint,in_loss:boolean>>>"))
    sized = F.transform(blocks, lambda runs: F.struct(runs.alias("runs"), total(runs).alias("length")))

    def block_texts(every: Column) -> Column:
        return F.transform(every, lambda b, i: F.struct(b["runs"].alias("runs"), F.substring(F.col("formatted"), (total(F.slice(every, F.lit(1), i)) + 1).cast("int"), b["length"].cast("int")).alias("text")))

    def in_loss(b: Column) -> Column:
        placed = F.transform(b["runs"], lambda r, i: F.struct(r["in_loss"].alias("in_loss"), (total(F.slice(b["runs"], F.lit(1), i)) + 1).alias("at"), r["length"].alias("length")))
        return F.transform(F.filter(placed, lambda r: r["in_loss"]), lambda r: F.substring(b["text"], r["at"].cast("int"), r["length"].cast("int")))

    # one element binds an array to a lambda variable, so that it is computed once
    cut = F.get(F.transform(F.array(sized), block_texts), F.lit(0))
    return F.flatten(F.transform(cut, in_loss))


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse `formatted` again: adds turns_read array<struct<role,text>> and loss_read, the unescaped text under the mask."""
    roles, texts = F.regexp_extract_all("formatted", F.lit(_TURN), 1), F.regexp_extract_all("formatted", F.lit(_TURN), 2)
    turns = F.transform(F.arrays_zip(roles.alias("role"), texts.alias("text")), lambda x: F.struct(unescape(x["role"]).alias("role"), unescape(x["text"]).alias("text")))
    cut = formatted.withColumn("turns_read", turns)
    return cut.select("*", F.array_join(F.transform(masked_texts(cut), unescape), "").alias("loss_read"))


def conversation_digests(conversations: DataFrame) -> DataFrame:
    """Format every conversation and return, read back from the output, its digests."""
    done = read_back(format_turns(canonical_turns(conversation_records(conversations))))
    spelled = F.array_join(F.transform("turns_read", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("turns_read").cast("long").alias("n_turns"), F.sha2(spelled, 256).alias("turns_sha256"),
        F.length("loss_read").cast("long").alias("loss_chars"), F.sha2("loss_read", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "layout", "fingerprint",
    )
