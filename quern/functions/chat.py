"""Chat rendering, loss masks and length weights as columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .basics import col


@dataclass(frozen=True)
class Template:
    """A chat format: marks around a turn, names of the roles, and the system message used where a row has none."""

    name: str
    system: str
    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    separator: str = "\n"
    roles: tuple[tuple[str, str], ...] = (("system", "system"), ("human", "user"), ("gpt", "assistant"))


TEMPLATES: dict[str, Template] = {}


def register_template(t: Template) -> Template:
    TEMPLATES[t.name] = t
    return t


register_template(Template("plain", ""))
register_template(Template("helpful", "You are a helpful assistant."))


def turns_array(rows: Column | str) -> Column:
    """Turns of a conversation with a leading non-human turn taken off, unless it is the system's."""
    c = col(rows)
    return F.when((F.size(c) > 0) & ~F.get(c, F.lit(0))["from"].isin("human", "system"), F.slice(c, 2, F.greatest(F.size(c), F.lit(1)))).otherwise(c)


def alternates(rows: Column | str) -> Column:
    """Whether turns after an optional system turn go human, gpt, human, ..."""
    c = col(rows)
    said = F.filter(c, lambda t: t["from"] != "system")
    return F.forall(F.transform(said, lambda t, i: t["from"] == F.when(i % 2 == 0, "human").otherwise("gpt")), lambda ok: ok)


def _role(t: Template, name: Column) -> Column:
    out = F.when(F.lit(False), "")
    for given, shown in t.roles:
        out = out.when(name == given, shown)
    return out.otherwise(name)


def render(rows: Column | str, template: Template) -> Column:
    """A conversation (array of from, value) as one text; the template's system message comes first unless the row has one."""
    t, c = template, col(rows)
    one = lambda x: F.concat(F.lit(t.start), _role(t, x["from"]), F.lit(t.separator), x["value"], F.lit(t.end + t.separator))
    head = f"{t.start}system{t.separator}{t.system}{t.end}{t.separator}" if t.system else ""
    own = F.coalesce(F.get(c, F.lit(0))["from"] == "system", F.lit(False))
    return F.concat(F.when(own, "").otherwise(head), F.array_join(F.transform(c, one), ""))


register_template(Template("joined", "", separator=""))
register_template(Template("tagged", "", start="<|", end="<|end|>", roles=(("system", "system|>"), ("human", "user|>"), ("gpt", "assistant|>"))))

#: Encoders by template name; a name without its own is rendered by its template.
ENCODERS: dict[str, Callable[[Column | str], Column]] = {}


def encoder(name: str) -> Callable[[Column | str], Column]:
    """The function that encodes conversations for a template's name; unknown names take the plain template."""
    return ENCODERS.get(name) or (lambda rows: render(rows, TEMPLATES.get(name, TEMPLATES["plain"])))


def mask_turn(ids: Column, learned: Column, prefix: Column | int, ignore: int = -100) -> Column:
    """Labels of a turn's ids: all ignored unless learned, then without the role prefix and the closing newline."""
    prefix = F.lit(prefix) if isinstance(prefix, int) else prefix
    last = F.size(ids) - 1
    return F.transform(ids, lambda x, i: F.when(learned & (i >= prefix) & (i < last), x).otherwise(F.lit(ignore)))


def expand_markers(text: Column, mark: str, counts: Column, token: str, start: str = "<img>", end: str = "</img>") -> Column:
    """The i-th mark becomes start, counts[i] tokens, end; marks beyond the counts stay."""
    parts = F.split(text, "\\Q" + mark + "\\E", -1)
    joined = F.transform(parts, lambda p, i: F.concat(
        F.when(i == 0, "").when(i <= F.size(counts), F.concat(F.lit(start), F.repeat(F.lit(token), F.get(counts, i - 1)), F.lit(end))).otherwise(mark), p))
    return F.array_join(joined, "")


def frame_lines(count: Column) -> Column:
    """Frame1: <image> and so on, a line each."""
    return F.array_join(F.transform(F.sequence(F.lit(1), count), lambda i: F.concat(F.lit("Frame"), i.cast("string"), F.lit(": <image>"))), "\n")


def length_weight(length: Column | str, mode: str = "square") -> Column:
    """Loss weight of a sample by its learned tokens: token 1, sample 1 / x, square 1 / sqrt(x); 0 for none."""
    x = col(length)
    by = {"token": F.lit(1.0), "sample": 1 / x, "square": 1 / F.sqrt(x)}[mode]
    return F.when(x > 0, by).otherwise(0.0)
