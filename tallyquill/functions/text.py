"""Scalar functions over strings: answers, tags, prompts. All are Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The tags of programs and answers, and the names of operations.
PROGRAM = ("<begin_of_program>", "<end_of_program>")
ANSWER = ("<begin_of_answer>", "<end_of_answer>")
OPERATION = r"(add|subtract|multiply|divide)\s*\("
NUMBER = r"[-+]?\d*\.?\d+"


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def strip(c: Column) -> Column:
    """Trims all white space, not only spaces."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def to_double(c: Column) -> Column:
    """The number that a plain decimal literal says, else null; no casts that only one engine knows."""
    return F.when(c.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), strip(c).try_cast("double"))


def double_text(d: Column) -> Column:
    """A double as text with at least one decimal: 7 is "7.0", 1e7 is "10000000.0"."""
    whole = (d == F.floor(d)) & (F.abs(d) < 1e16)
    plain = F.concat(F.regexp_replace(d.cast("decimal(38,12)").cast("string"), r"0+$", ""))
    return F.when(whole, F.concat(d.cast("decimal(38,0)").cast("string"), F.lit(".0"))).when((F.abs(d) >= 1e7) & (F.abs(d) < 1e16), plain).otherwise(d.cast("string"))


def tenths(d: Column) -> Column:
    """A double rounded to one decimal as its exact binary value says, halves to even."""
    a = F.abs(d)
    whole, frac = F.floor(a), a - F.floor(a)
    low = F.floor(frac * 10)
    middle = (low * 2 + 1) / F.lit(20.0)
    # a fraction that equals the double of k/20 is a true half at .25 and .75 only; elsewhere that double lies a little beside it
    half = F.when(low.isin(2, 7), low % 2 == 1).otherwise(low.isin(0, 4, 5, 6))
    up = F.when(frac > middle, True).when(frac < middle, False).otherwise(half)
    n = (whole * 10 + low + F.when(up, 1).otherwise(0)).cast("long")
    text = F.concat((n / 10).cast("decimal(38,1)").cast("string"))
    return F.concat(F.when((d < 0) & (n >= 0), F.lit("-")).otherwise(F.lit("")), text)


def tag_content(c: Column, tag: tuple[str, str]) -> Column:
    """What stands between the tags, trimmed; null without them."""
    pattern = rf"(?s){tag[0]}(.*?){tag[1]}"
    return F.when(c.rlike(pattern), strip(F.regexp_extract(c, pattern, 1)))


def extract_answer(c: Column) -> Column:
    """the ``<answer>`` tag, else what follows "The answer is", else the whole text."""
    tag, said = r"(?s)<answer>(.*?)</answer>", r"(?s)(?:The answer is|Answer:)\s*(.*?)(?:\.|\z)"
    return F.when(c.rlike(tag), strip(F.regexp_extract(c, tag, 1))).when(c.rlike(said), strip(F.regexp_extract(c, said, 1))).otherwise(strip(c))


def normalize_answer(c: Column) -> Column:
    """percentages to one decimal, dollar amounts to a double's text, numbers shortened, the rest lower case."""

    def normal(x: Column) -> Column:
        t, percent, dollar, plain = x["t"], x["percent"], x["dollar"], x["plain"]
        short = F.regexp_replace(F.regexp_replace(F.bround(plain.cast("decimal(38,12)"), 4).cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
        number = F.when(plain == F.floor(plain), plain.cast("decimal(38,0)").cast("string")).otherwise(short)
        return (
            F.when(t.contains("%") & percent.isNotNull(), F.concat(tenths(percent), F.lit("%")))
            .when(t.contains("$") & dollar.isNotNull(), double_text(dollar))
            .when(plain.isNotNull(), number)
            .otherwise(F.lower(t))
        )

    numbers = lambda t: F.struct(t.alias("t"), to_double(F.replace(t, F.lit("%"), F.lit(""))).alias("percent"), to_double(F.regexp_replace(t, "[$,]", "")).alias("dollar"), to_double(t).alias("plain"))
    return let(let(strip(c), numbers), normal)


def is_answer_correct(predicted: Column, gold: Column, tolerance: float = 0.01) -> Column:
    """equal after normalising, or near by the relative (for a gold of 0 the absolute) difference."""
    number = lambda x: to_double(F.replace(x, F.lit("%"), F.lit("")))

    def judge(x: Column) -> Column:
        a, b = x["a"], x["b"]
        near = F.when(b != 0, F.abs(a - b) / F.abs(b) <= tolerance).otherwise(F.abs(a - b) <= tolerance)
        return F.coalesce(F.when(x["p"] == x["g"], True).otherwise(near), F.lit(False))

    both = F.struct(normalize_answer(predicted).alias("p"), normalize_answer(gold).alias("g"))
    return let(let(both, lambda x: F.struct(x["p"], x["g"], number(x["p"]).alias("a"), number(x["g"]).alias("b"))), judge)


def answer_within(predicted: Column, gold: Column, tolerance: float = 1e-5) -> Column:
    """absolute tolerance, else equal after trimming."""
    a, b = to_double(predicted), to_double(gold)
    return F.coalesce(F.when(a.isNotNull() & b.isNotNull(), F.abs(a - b) <= tolerance).otherwise(strip(predicted) == strip(gold)), F.lit(False))


def tagged(program: Column, answer: Column) -> Column:
    """The canonical block of a program and an answer."""
    return F.concat(F.lit(f"{PROGRAM[0]}\n"), program, F.lit(f"\n{PROGRAM[1]}\n\n{ANSWER[0]}\n"), answer, F.lit(f"\n{ANSWER[1]}"))


def clean_output(c: Column) -> Column:
    """only the tags, in canonical form; EOF and N/A where one is missing."""
    return tagged(F.coalesce(tag_content(c, PROGRAM), F.lit("EOF")), F.coalesce(tag_content(c, ANSWER), F.lit("N/A")))


def program_and_answer(c: Column) -> Column:
    """both contents as a struct, EOF and N/A where one is missing."""
    return F.struct(F.coalesce(tag_content(c, PROGRAM), F.lit("EOF")).alias("program"), F.coalesce(tag_content(c, ANSWER), F.lit("N/A")).alias("answer"))


def last_assistant_turn(c: Column) -> Column:
    """the last assistant turn of chat markup, else the text itself."""
    found = F.regexp_extract_all(c, F.lit(r"(?s)<\|im_start\|>assistant\n(.*?)(?:<\|im_end\|>|\z)"), 1)
    marked = c.contains("<|im_start|>") & c.contains("<|im_end|>") & (F.size(found) > 0)
    return F.when(marked, strip(F.element_at(found, -1))).otherwise(c)


#: Where an answer may stand, in the order in which the places are tried.
ANSWER_PLACES = (
    r"(?i)(?:answer|result|value)(?:\s+is|\s*[:=])\s*([-+]?\d*\.?\d*)",
    r"(?i)(?:=|equals)\s*([-+]?\d*\.?\d*)",
    r"(?i)(?:[\$£€])\s*([-+]?\d*\.?\d*)",
    r"(?i)(?:final answer|final result)(?:\s+is|\s*[:=])\s*([-+]?\d*\.?\d*)",
    r"(?i)(?:calculated|computation|calculation)(?:\s+result|\s+answer)(?:\s+is|\s*[:=])\s*([-+]?\d*\.?\d*)",
    r"(?i)(?:therefore|thus|so)(?:,|\s+the\s+answer\s+is|\s+the\s+result\s+is)\s*([-+]?\d*\.?\d*)",
    r"(?i)(?:answer|result)(?:\s*:|\s+is)\s*([-+]?\d*\.?\d*)",
    r"(?i)(?:^|\n|\.\s+)(\d+\.?\d*)(?:\s*$|\n)",
    r"(?i)(?:add|subtract|multiply|divide)\s*\([^)]*\)\s*=\s*([-+]?\d*\.?\d*)",
    r"(?i)\d+\s*[+\-*/]\s*\d+\s*=\s*([-+]?\d*\.?\d*)",
    r"(?i)([-+]?\d*\.?\d+)(?:\s*$|\n\s*$)",
)


def robust_answer(c: Column) -> Column:
    """the tag, else the first place that holds a number, else the last number, else N/A."""

    def find(t: Column) -> Column:
        inside = tag_content(t, ANSWER)
        numbers = F.regexp_extract_all(t, F.lit(NUMBER), 0)
        last = F.coalesce(F.element_at(F.when(F.size(numbers) > 0, numbers), -1), F.lit("N/A"))
        places = [F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in ANSWER_PLACES]
        return F.when(inside.isNotNull(), F.when(F.lower(inside) == "and", last).otherwise(inside)).otherwise(F.coalesce(*places, last))

    return let(last_assistant_turn(c), find)


def training_answer(c: Column, chat: bool = False) -> Column:
    """the tag's number or lower-case text, else the first number said, else the text; as (num, str).

    With ``chat`` the text "and" alone is 0, and without a tag the last assistant turn of chat markup
    counts: its first number, else its text.
    """
    inside = tag_content(c, ANSWER)
    clean = F.trim(F.regexp_replace(F.regexp_replace(inside, "[%$,]", ""), r"\s+", " "))
    is_number = clean.rlike(r"^-?\d+\.?\d*$")
    said = (r"(?i)(?:answer|result|value)(?:\s+is|\s*[:=])\s*([-\d\.\,]+)", r"(?i)(?:=|equals)\s*([-\d\.\,]+)", r"(?i)(?:[\$£€])\s*([-\d\.\,]+)")
    numbers = F.coalesce(*(to_double(F.replace(F.regexp_extract(c, p, 1), F.lit(","), F.lit(""))) for p in said))
    num = F.when(inside.isNotNull(), F.when(is_number, clean.try_cast("double")))
    text = F.when(inside.isNotNull(), F.when(~is_number, F.lower(clean)))
    if chat:
        turns = F.regexp_extract_all(c, F.lit(r"(?s)<\|im_start\|>assistant\n(.*?)<\|im_end\|>"), 1)
        turn = strip(F.element_at(F.when(F.size(turns) > 0, turns), -1))
        first = F.nullif(F.regexp_extract(turn, r"(-?\d+\.?\d*)", 1), F.lit(""))
        mere = F.lower(strip(c)) == "and"
        num = F.when(mere, F.lit(0.0)).when(inside.isNotNull(), num).when(turn.isNotNull(), first.try_cast("double")).otherwise(numbers)
        text = F.when(mere, F.lit(None).cast("string")).when(inside.isNotNull(), text).when(turn.isNotNull(), F.when(first.isNull(), F.lower(turn))).when(numbers.isNull(), F.lower(strip(c)))
    else:
        num, text = F.when(inside.isNotNull(), num).otherwise(numbers), F.when(inside.isNotNull(), text).when(numbers.isNull(), F.lower(strip(c)))
    return F.struct(num.alias("num"), text.alias("str"))


def is_valid_output(c: Column) -> Column:
    """both tags, an operation or EOF, and neither content a mere word."""
    tags = [c.contains(t) for t in (*PROGRAM, *ANSWER)]
    program, answer = tag_content(c, PROGRAM), tag_content(c, ANSWER)
    words = ["and", "or", "the", "is", "a", "an"]
    mere = program.isNotNull() & answer.isNotNull() & (F.lower(program).isin(words) | F.lower(answer).isin(words))
    return tags[0] & tags[1] & tags[2] & tags[3] & (c.rlike(f"(?i){OPERATION}") | c.contains("EOF")) & ~F.coalesce(mere, F.lit(False))


def validate_format(c: Column) -> Column:
    """both tags, no whole number right after an operation's parenthesis, and one number as the answer."""
    program, answer = tag_content(c, PROGRAM), tag_content(c, ANSWER)
    bare = program.rlike(r"\(\s+\d+(\s|$)")
    number = F.regexp_replace(answer, "[$,%]", "").rlike(r"^-?\d+\.?\d*$")
    return F.coalesce(program.isNotNull() & answer.isNotNull() & ~bare & ~answer.contains("\n") & ~answer.contains("  ") & number, F.lit(False))


def clean_html(c: Column) -> Column:
    """F16: drops tags."""
    return F.regexp_replace(c, "<.*?>", "")


def remove_space(c: Column) -> Column:
    """single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, " +", " "))


def row_to_text(header: Column, row: Column) -> Column:
    """a table row as a sentence, ``"h0 the r0 of h1 is c1 ; ..."``."""
    n = F.least(F.size(header), F.size(row))
    cells = F.zip_with(F.slice(header, 2, F.greatest(n - 1, F.lit(0))), F.slice(row, 2, F.greatest(n - 1, F.lit(0))), lambda h, c: F.concat(F.lit("the "), row[0], F.lit(" of "), h, F.lit(" is "), c, F.lit(" ; ")))
    head = F.when(header[0] != "", F.concat(header[0], F.lit(" "))).otherwise("")
    return strip(F.concat(head, F.array_join(cells, "")))


def canonical_answer(c: Column) -> Column:
    """a label's number as a double's text, else the label as it is."""
    return F.coalesce(double_text(to_double(F.regexp_replace(c, "[$%,]", ""))), c)


def numbered_list(c: Column) -> Column:
    """the items of a numbered list, else the lines that aren't empty."""
    lines = F.filter(F.transform(F.split(strip(c), "\n"), strip), lambda x: x != "")
    items = F.filter(F.transform(lines, lambda x: strip(F.regexp_extract(x, r"^\d+\.?\s*(.+)$", 1))), lambda x: x != "")
    return F.when(F.size(items) > 0, items).otherwise(lines)


def query_analysis(c: Column) -> Column:
    """what an analysis in words says: a flag and four bracketed lists."""
    def listed(name: str) -> Column:
        inner = F.regexp_extract(c, rf"(?is){name}:?\s*\[(.*?)\]", 1)
        return F.filter(F.transform(F.split(inner, ","), lambda x: F.regexp_replace(strip(x), r"^['\"]+|['\"]+$", "")), lambda x: x != "").alias(name)

    return F.struct(F.lower(c).contains("true").alias("needs_numerical_computation"), *map(listed, ("values_to_extract", "operations", "time_periods", "financial_metrics")))


#: Words that make a question one for numeric operations; parts of words count.
NUMERIC_TERMS = "calculate|compute|sum|average|mean|total|difference|percent|percentage|ratio|compare|growth|increase|decrease"


def asks_for_numbers(c: Column) -> Column:
    """F24."""
    return F.lower(c).rlike(NUMERIC_TERMS)


def keywords(c: Column) -> Column:
    """lower-case words of more than three characters."""
    return F.filter(F.split(F.lower(c), r"\s+"), lambda w: F.length(w) > 3)


def history_text(history: Column) -> Column:
    """earlier turns, an array of (question, predicted), as a prompt's lines."""
    return F.array_join(F.transform(history, lambda h, i: F.concat(F.lit("Q"), (i + 1).cast("string"), F.lit(": "), h["question"], F.lit("\nA"), (i + 1).cast("string"), F.lit(": "), h["predicted"], F.lit("\n\n"))), "")


def prompt(context: Column, history: Column, question: Column) -> Column:
    """context, history and question."""
    return F.concat(F.lit("Context:\n"), context, F.lit("\n\n"), history_text(history), F.lit("Question: "), question, F.lit("\nAnswer:"))


def chat_prompt(context: Column, history: Column, question: Column, rules: str) -> Column:
    """the two messages of a chat prompt, ``rules`` and what is asked, as an array of (role, content)."""
    asked = F.concat(F.lit("CONTEXT:\n"), context, F.lit("\n\nQUESTION:\n"), question, F.lit("\n\nPREVIOUS CONVERSATION:\n"), history_text(history))
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(rules).alias("content")), F.struct(F.lit("user").alias("role"), asked.alias("content")))


def instruct_prompt(question: Column, context: Column, rules: str) -> Column:
    """the prompt of an instruction model, with the context where there is one."""
    opening = F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit(CONTEXT_OPENING), context, F.lit("\n\n"))).otherwise("")
    return F.concat(F.lit(f"<s>[INST] <<SYS>>\n{rules}\n<</SYS>>\n\n"), opening, question, F.lit(" [/INST]"))


#: Per template the text before the first message, and before and after each role's.
TEMPLATES = {
    "qwen": ("", {r: (f"<|im_start|>{r}\n", "<|im_end|>\n") for r in ("system", "user", "assistant")}),
    "yi": ("", {r: (f"<|im_start|>{r}\n", "<|im_end|>\n") for r in ("system", "user", "assistant")}),
    "chatml": ("", {r: (f"<|im_start|>{r}\n", "<|im_end|>\n") for r in ("system", "user", "assistant")}),
    "claude": ("", {"system": ("", "\n"), "user": ("Human: ", "\n"), "assistant": ("Assistant: ", "\n")}),
    "gemma-3": ("<bos>", {"system": ("", "\n"), "user": ("<start_of_turn>user\n", "<end_of_turn>\n"), "assistant": ("<start_of_turn>model\n", "<end_of_turn>\n")}),
    "llama-3.1": ("", {r: (f"<|{r}|>\n", "\n") for r in ("system", "user", "assistant")}),
}
#: The models' own formats, for the names that have no template above.
TEMPLATES |= {
    "llama-2": ("<s>", {"system": ("<<SYS>>\n", "\n<</SYS>>\n\n"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s><s>")}),
    "phi-4": ("", {r: (f"<|im_start|>{r}<|im_sep|>", "<|im_end|>") for r in ("system", "user", "assistant")}),
    "gemma": TEMPLATES["gemma-3"],
    "phi-2": ("", {"system": ("", "\n"), "user": ("Instruct: ", "\n"), "assistant": ("Output: ", "\n")}),
    "falcon": ("", {"system": ("System: ", "\n"), "user": ("User: ", "\n"), "assistant": ("Falcon: ", "\n")}),
}


def render(messages: Column, template: str) -> Column:
    """an array of (role, content) as one text; roles that the template doesn't know are left out."""
    start, roles = TEMPLATES[template]

    def one(m: Column) -> Column:
        said = F.lit("")
        for role, (before, after) in roles.items():
            names = [role, "human"] if role == "user" else [role]
            said = F.when(m["role"].isin(names), F.concat(F.lit(before), m["content"], F.lit(after))).otherwise(said)
        return said

    return F.concat(F.lit(start), F.array_join(F.transform(messages, one), ""))


#: Parts of a model's name and its template; the first that fits counts.
TEMPLATE_NAMES = (
    ("phi-4|phi4", "phi-4"), ("qwen2|qwen-2", "qwen"), (r"llama-3\.1|llama3\.1", "llama-3.1"), ("llama|mistral", "llama-2"), ("gemma-3|gemma3", "gemma-3"),
    ("gemma", "gemma"), ("phi-2|phi2", "phi-2"), ("falcon", "falcon"), ("yi", "yi"), ("claude", "claude"),
)


def template_name(model: Column) -> Column:
    """F28."""
    found = F.lit("chatml")
    for pattern, name in reversed(TEMPLATE_NAMES):
        found = F.when(F.lower(model).rlike(pattern), F.lit(name)).otherwise(found)
    return found


def inject_answer_tags(messages: Column) -> Column:
    """an assistant message with a number but no answer tag becomes a block with that number."""
    def one(m: Column) -> Column:
        number = F.regexp_extract(m["content"], r"(-?\d+\.?\d*)", 1)
        untagged = (m["role"] == "assistant") & ~m["content"].contains(ANSWER[0]) & ~m["content"].contains(ANSWER[1]) & (number != "")
        return F.struct(m["role"].alias("role"), F.when(untagged, tagged(F.lit("EOF"), number)).otherwise(m["content"]).alias("content"))

    return F.transform(messages, one)


def route(question: Column) -> Column:
    """F30 (extension): whether tables or texts should answer a question."""
    return F.when(F.lower(question).rlike(r"table|row|column|total|how much|how many|percent|\d{4}"), "table").otherwise("text")


#: What stands before a context.
CONTEXT_OPENING = "I'm looking at some financial data. Here's the context:\n\n"


def prompt_answer(c: Column) -> Column:
    """the tag, else the number after "answer is" or "=", else a remark."""
    said = (r"(?i)(?:answer|result|value)(?:\s+is|\s*[:=])\s*([\d\.\,\$]+)", r"(?i)(?:=|equals)\s*([\d\.\,\$]+)")
    return F.coalesce(tag_content(c, ANSWER), *(F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in said), F.lit("No explicit answer found"))
