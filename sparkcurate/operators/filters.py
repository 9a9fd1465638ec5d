"""Row predicates of the curation pipeline, as Column builders.

Every predicate gives true or false, never null (a null text or array counts as empty), so `keep` and its negation hold every row
between them.  `apply_filters` evaluates all rules in one pass and names the first rule that fails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcurate.functions.textfn import BLANKS, count_of, strip, text0

#: Scripts that mark a text as not English, and the spellings of outdated Python.
FOREIGN_SCRIPT = "[一-鿿぀-ゟ゠-ヿЀ-ӿ؀-ۿ]"
LEGACY_PYTHON = (
    r"\bprint\s+[^(]",
    r"\.has_key\(",
    r"\bxrange\b",
    r"<>\s",
    r"^class\s+\w+:",
    r"\bexecfile\b",
    r"\bunicode\b",
    r"from\s+__future__",
)
#: A literal of each of these patterns.
LEGACY_WORDS = ("print", ".has_key(", "xrange", "<>", "class", "execfile", "unicode", "__future__")
#: What Python sources hold.
PYTHON_WORDS = ("def ", "class ", "import ", "from ")
ROLES = ("system", "user", "assistant", "tool")


def any_message(messages: Column, test) -> Column:
    """Some message's content passes; false for a null or empty array."""
    return F.coalesce(F.exists(messages, lambda m: test(text0(m["content"]))), F.lit(False))


def all_messages(messages: Column, test) -> Column:
    return F.coalesce(F.forall(messages, lambda m: test(text0(m["content"]))), F.lit(True))


def is_language(messages: Column, language: str = "en") -> Column:
    """No message has a character of another script; languages other than English keep everything."""
    return ~any_message(messages, lambda c: c.rlike(FOREIGN_SCRIPT)) if language == "en" else F.lit(True)


def is_modern_python(messages: Column, min_version: str = "3.10") -> Column:
    """No message has an outdated spelling.  min_version is accepted and changes nothing.  Prose that looks like one is rejected too."""

    def test(c: Column) -> Column:
        # the words are looked for first: few texts have one, and only those go through the expression
        return contains_any(c, LEGACY_WORDS) & c.rlike("(?dm)" + "|".join(LEGACY_PYTHON))

    return ~any_message(messages, test)


def is_quality(messages: Column, min_messages: int = 2, min_chars: int = 10) -> Column:
    """Enough messages, each with enough characters once stripped, the last by the assistant.  With min_messages 0 an empty array passes."""
    n = F.coalesce(F.size(messages), F.lit(0))
    last = F.when(n > 0, F.element_at(messages, -1)["role"])
    return (n >= min_messages) & all_messages(messages, lambda c: F.length(strip(c)) >= min_chars) & ((n == 0) | F.coalesce(last == "assistant", F.lit(False)))


def code_lines(code: Column) -> Column:
    """Lines that are neither blank nor comments."""
    bare = lambda x: F.btrim(x, F.lit(BLANKS))
    return F.size(F.filter(F.split(text0(code), "\n"), lambda x: (F.length(bare(x)) > 0) & ~bare(x).startswith("#")))


def is_code_sample(code: Column, min_chars: int = 100, min_lines: int = 5) -> Column:
    return (F.length(strip(text0(code))) >= min_chars) & (code_lines(code) >= min_lines)


def code_quality(code: Column) -> Column:
    """0 to 1: .2 each for a doc string, type hints, a class, a function; .1 without and .05 with up to two open notes; .1 for 5 to 30 % comments."""
    c = text0(code)
    notes = count_of(F.lower(c), "todo") + count_of(F.lower(c), "fixme")
    lines = F.split(c, "\n")
    comments = F.size(F.filter(lines, lambda x: F.btrim(x, F.lit(BLANKS)).startswith("#"))) / F.greatest(F.size(lines), F.lit(1))
    part = lambda test, value: F.when(test, F.lit(value)).otherwise(F.lit(0.0))
    return (
        part(c.contains('"""') | c.contains("'''"), 0.2)
        + part(c.contains("->") | c.contains(": "), 0.2)
        + part(c.contains("class "), 0.2)
        + part(c.contains("def "), 0.2)
        + F.when(notes == 0, 0.1).when(notes <= 2, 0.05).otherwise(0.0)
        + part((comments >= 0.05) & (comments <= 0.30), 0.1)
    )


def is_code_file(code: Column) -> Column:
    """100 to 50,000 characters, 10 to 2,000 lines, a Python keyword, quality of at least .3."""
    c = text0(code)
    lines = F.size(F.split(c, "\n"))
    return F.length(c).between(100, 50_000) & lines.between(10, 2_000) & contains_any(c, PYTHON_WORDS) & (code_quality(c) >= 0.3)


#: Kinds of projects, in order, and the words of each.  The text is lowered and the words are not, so those of "typing" never match.
DIVERSITY = (
    ("web", ("flask", "django", "fastapi", "starlette", "tornado", "bottle")),
    ("data", ("pandas", "numpy", "scipy", "sklearn", "tensorflow", "pytorch")),
    ("testing", ("pytest", "unittest", "mock", "fixture", "parametrize")),
    ("cli", ("argparse", "click", "typer", "fire", "docopt")),
    ("async", ("asyncio", "aiohttp", "trio", "anyio")),
    ("typing", ("Protocol", "TypeVar", "Generic", "Callable", "Union")),
    ("tools", ("setuptools", "poetry", "flit", "build", "wheel")),
)


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def diversity_category(code: Column) -> Column:
    """The first kind of project a word of which the code holds; null for none."""
    lowered = F.lower(text0(code))
    return F.coalesce(*(F.when(contains_any(lowered, words), name) for name, words in DIVERSITY))


#: Accesses to fields of results.
RESULT_FIELDS = (".error_count", ".errors", ".success", ".locations", ".references")


def example_priority(answer: Column) -> Column:
    """10 for a field of a result, 5 for a branch on a result, 5 for a loop over one, 3 for three line breaks or more, 2 for a tool call."""
    c = text0(answer)
    part = lambda test, n: F.when(test, n).otherwise(0)
    loop = c.contains("for ") & (c.contains(" in result") | c.contains(".errors"))
    return part(contains_any(c, RESULT_FIELDS), 10) + part(c.contains("if result"), 5) + part(loop, 5) + part(count_of(c, "\n") >= 3, 3) + part(c.contains("<tool_call>"), 2)


def role_count(messages: Column, role: str) -> Column:
    return F.coalesce(F.size(F.filter(messages, lambda m: m["role"] == role)), F.lit(0))


def total_chars(messages: Column) -> Column:
    return F.coalesce(F.aggregate(messages, F.lit(0).cast("bigint"), lambda s, m: s + F.length(text0(m["content"]))), F.lit(0))


def has_sequence(messages: Column, tests: list) -> Column:
    """Some run of consecutive messages passes the tests one by one; false where there are too few."""
    k = len(tests)

    def at(i: Column) -> Column:
        out = F.lit(True)
        for d, test in enumerate(tests):
            out = out & F.coalesce(test(F.get(messages, i + d)), F.lit(False))
        return out

    n = F.coalesce(F.size(messages), F.lit(0))
    return F.when(n >= k, F.exists(F.sequence(F.lit(0), n - k), at)).otherwise(F.lit(False))


def has_tool_pattern(messages: Column) -> Column:
    """An assistant's tool call, then a result, then an assistant's answer."""
    return has_sequence(messages, [lambda m: (m["role"] == "assistant") & m["content"].contains("<tool_call>"), lambda m: m["role"].isin("user", "tool"), lambda m: m["role"] == "assistant"])


def is_transcript(messages: Column, max_tokens: int = 2048) -> Column:
    """Under four characters a token in all, with system, user and assistant; tool records need the call pattern, others at most three user
    turns, as many answers, and under 3,000 characters."""
    roles = (role_count(messages, "system") > 0) & (role_count(messages, "user") > 0) & (role_count(messages, "assistant") > 0)
    calls = any_message(messages, lambda c: c.contains("<tool_call>"))
    plain = (role_count(messages, "user") <= 3) & (role_count(messages, "user") == role_count(messages, "assistant")) & (total_chars(messages) < 3000)
    return (total_chars(messages) <= 4 * max_tokens) & roles & F.when(calls, has_tool_pattern(messages)).otherwise(plain)


def by_assistant(messages: Column, test) -> Column:
    return F.coalesce(F.exists(messages, lambda m: F.coalesce(m["role"] == "assistant", F.lit(False)) & test(text0(m["content"]))), F.lit(False))


def has_json_call(messages: Column) -> Column:
    """An assistant's tool call in a JSON fence."""
    return by_assistant(messages, lambda c: c.contains("```json") & c.contains('"name"'))


def mentions(messages: Column, *needles: str) -> Column:
    def test(c: Column) -> Column:
        out = F.lit(False)
        for x in needles:
            out = out | F.lower(c).contains(x.lower())
        return out

    return any_message(messages, test)


def is_relevant(messages: Column, frameworks: tuple[str, ...]) -> Column:
    """Records without a tool call are kept; those with one must mention a framework or source path."""
    return ~any_message(messages, lambda c: c.contains("<tool_call>")) | mentions(messages, *frameworks)


def is_tool_response(text: Column) -> Column:
    t = F.lower(F.trim(text0(text)))
    return t.startswith("<tool_response>") | t.startswith("tool result:") | t.startswith("<tool_result>")


#: The detectors of tool records differ on purpose; each is kept under its own name.
TOOL_DETECTORS = {
    "tags": lambda c: c.contains("<tool_call>") | c.contains("```json") | c.contains("<function="),
    "phrases": lambda c: c.contains("I'll use the") | (c.contains("```json") & c.contains('"name":')) | c.contains("Tool result:"),
    "call": lambda c: c.contains("<tool_call>"),
    "fence": lambda c: c.contains("```json"),
    "result": lambda c: c.contains("Tool result:") | c.contains("<tool_response>"),
}


def is_malformed(messages: Column) -> Column:
    """No array of messages, or fewer than two."""
    return F.coalesce(F.size(messages), F.lit(0)) < 2


def has_no_calls(calls: Column) -> Column:
    return F.coalesce(F.size(calls), F.lit(0)) == 0


def called_all(text: Column, names: Column) -> Column:
    """Every name is called in the text; true for no names."""
    return F.coalesce(F.forall(names, lambda n: text0(text).contains(F.concat(n, F.lit("(")))), F.lit(True))


def accesses_field(text: Column, fields: Column) -> Column:
    return F.coalesce(F.exists(fields, lambda f: text0(text).contains(F.concat(F.lit("."), f))), F.lit(False))


def apply_filters(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df with `keep` and `failed_rule`, the first rule that fails, in order; null for kept rows."""
    failed = F.coalesce(*(F.when(~test, F.lit(name)) for name, test in rules.items()))
    return df.withColumn("failed_rule", failed).withColumn("keep", F.col("failed_rule").isNull())
