"""Column functions on roles, messages and prompts.

Messages are arrays of structs (role, content); a message's other key names are settled by ``message``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import clean_message, strip


def _capital(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def role_export(c: Column) -> Column:
    """User, Assistant, or the role with a capital; Unknown if empty."""
    r = F.lower(F.coalesce(c, F.lit("")))
    return F.when(r.isin("user", "human", "prompter"), "User").when(r.isin("assistant", "gpt", "bot"), "Assistant").when(r == "", "Unknown").otherwise(_capital(r))


def role_pull(c: Column) -> Column:
    """The same in lower case and stripped; user if empty."""
    r = F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.when(r.isin("user", "human", "prompter"), "user").when(r.isin("assistant", "gpt", "bot"), "assistant").when(r == "", "user").otherwise(r)


def role_instruct(c: Column, empty: str = "Unknown") -> Column:
    """The stripped role with a capital; ``empty`` if there is none (Unknown, or User in the decoder format)."""
    r = F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.when(r == "", empty).otherwise(_capital(r))


def _first_set(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def message(m: Column) -> Column:
    """(role, content) of a struct with any of role, from, speaker and content, value, text."""
    return F.struct(_first_set(m["role"], m["from"], m["speaker"]).alias("role"), _first_set(m["content"], m["value"], m["text"]).alias("content"))


def format_messages(messages: Column) -> Column:
    """A line ``Role: content`` a message; those without content are left out."""
    full = F.filter(messages, lambda m: strip(F.coalesce(m["content"], F.lit(""))) != "")
    return F.array_join(F.transform(full, lambda m: F.concat(role_export(m["role"]), F.lit(": "), strip(m["content"]))), "\n")


def format_instruction(instruction: Column, context: Column, response: Column) -> Column:
    def part(name: str, c: Column) -> Column:
        c = strip(F.coalesce(c, F.lit("")))
        return F.when(c != "", F.concat(F.lit(name), c))

    return F.concat_ws("\n", part("Instruction: ", instruction), part("Context: ", context), part("Assistant: ", response))


def normalize_messages(messages: Column) -> Column:
    """Cleaned messages with lower-case roles; null if any is empty or there are none."""
    made = F.transform(messages, lambda m: F.struct(role_pull(m["role"]).alias("role"), clean_message(m["content"]).alias("content")))
    return F.when((F.size(messages) > 0) & ~F.exists(made, lambda m: m["content"] == ""), made)


def question_messages(system: Column, question: Column, response: Column) -> Column:
    """[system,] user, assistant from three texts; null without question or response."""
    def one(role: str, c: Column) -> Column:
        c = clean_message(c)
        return F.when(c != "", F.struct(F.lit(role).alias("role"), c.alias("content")))

    return F.when((clean_message(question) != "") & (clean_message(response) != ""), F.array_compact(F.array(one("system", system), one("user", question), one("assistant", response))))


def wrap_instruction(q: Column) -> Column:
    return F.concat(F.lit("### Instruction:\n"), q, F.lit("\n\n### Response:\n"))


def wrap_chat(q: Column, style: str = "chat") -> Column:
    if style == "qa":
        return F.concat(F.lit("Q: "), q, F.lit("\nA:"))
    return F.concat(F.lit("User: "), q, F.lit("\nAssistant:"))


def history_block(role: Column, content: Column) -> Column:
    """One turn in the form with ### headings."""
    return F.concat(F.lit("### "), role, F.lit(":\n"), content, F.lit("\n\n"))


def history_line(role: Column, content: Column) -> Column:
    """One turn in the form of lines."""
    return F.concat(role, F.lit(": "), content, F.lit("\n"))


def messages_to_prompt(contents: Column) -> Column:
    """Contents stripped and joined by spaces, without empty ones."""
    return F.array_join(F.filter(F.transform(contents, lambda c: strip(F.coalesce(c, F.lit("")))), lambda c: c != ""), " ")
