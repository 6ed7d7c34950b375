"""String columns: trimming, tag cleaning, templates, postal codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import (
    CONTEXT_BLOCK,
    EXCERPT_CHARS,
    UNKNOWN_CITY,
    UNKNOWN_DATE,
    UNKNOWN_TITLE,
    WHITESPACE,
)

# The white space above as the inside of a regular-expression class.
_SPACE = "".join(f"\\x{{{ord(ch):x}}}" for ch in WHITESPACE)


def strip(c) -> Column:
    """Trim Unicode white space at both ends (Spark's plain ``trim`` removes spaces only)."""
    return F.btrim(c, F.lit(WHITESPACE))


def blank_to_null(c) -> Column:
    """Trimmed text, NULL when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def is_missing(c) -> Column:
    """True for the spellings of "no value": only white space, or ``nan`` in any case."""
    return F.lower(strip(c)).isin("", "nan")


def missing_to_null(c) -> Column:
    """Trimmed text; NULL when it is missing."""
    return F.when(~is_missing(c), strip(c))


def contains_any(text: Column, words) -> Column:
    """True when any of the words is a substring; words are a short list fixed before planning."""
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


def strip_basic_html(c) -> Column:
    """Delete ``<p>`` and ``</p>``, turn ``<br>`` into a newline; any other tag or entity stays."""
    no_open = F.replace(c, F.lit("<p>"), F.lit(""))
    no_close = F.replace(no_open, F.lit("</p>"), F.lit(""))
    return F.replace(no_close, F.lit("<br>"), F.lit("\n"))


def event_text(title, city, department, start, end, description) -> Column:
    """The four-line text that represents an event."""
    return F.concat(
        F.lit("Titre: "), title,
        F.lit("\nLieu: "), city, F.lit(" ("), department, F.lit(")"),
        F.lit("\nDate: du "), start, F.lit(" au "), end,
        F.lit("\nDescription: "), description,
    )


def searchable_text(*parts) -> Column:
    """Non-blank parts joined by a space, lower-cased: the text in which topics are looked up."""
    return F.lower(F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts]))


def excerpt(c, size: int = EXCERPT_CHARS) -> Column:
    return F.substring(c, 1, size)


def postal_code(c) -> Column:
    """First five digits in a row in the text form of any value; NULL when there are none."""
    return F.nullif(F.regexp_extract(c.cast("string"), r"(\d{5})", 1), F.lit(""))


def arrondissement(code: Column) -> Column:
    """Paris district of a postal code as text without leading zero; NULL outside Paris."""
    return F.when(F.startswith(code, F.lit("75")), F.right(code, F.lit(2)).cast("int").cast("string"))


def date_phrase(start, end) -> Column:
    """``du A au B`` for two different dates, else ``A``, else the "unknown" phrase."""
    first, last = F.coalesce(start, F.lit("")), F.coalesce(end, F.lit(""))
    return (
        F.when((first != "") & (last != "") & (first != last), F.concat(F.lit("du "), first, F.lit(" au "), last))
        .when(first != "", first)
        .otherwise(F.lit(UNKNOWN_DATE))
    )


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """Fill the ``{name}`` placeholders of a template known before planning, any number of times each.

    The template is cut at its placeholders first, so braces inside the values are never read as placeholders.
    """
    pieces: list[Column | str] = [template]
    for name, value in values.items():
        cut: list[Column | str] = []
        for piece in pieces:
            if isinstance(piece, str):
                for i, text in enumerate(piece.split("{" + name + "}")):
                    cut.extend([text] if i == 0 else [value, text])
            else:
                cut.append(piece)
        pieces = cut
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])


def context_block(title, city, department, start, end, body) -> Column:
    """One event as shown to the answering model."""
    values = {
        "title": F.coalesce(title, F.lit(UNKNOWN_TITLE)),
        "city": F.coalesce(city, F.lit(UNKNOWN_CITY)),
        "department": F.coalesce(department, F.lit("")),
        "date": date_phrase(start, end),
        "text": strip(F.coalesce(body, F.lit(""))),
    }
    return fill_template(CONTEXT_BLOCK, values)


def title_and_city(title, city) -> Column:
    """``title - city`` without blanks and hyphens at the ends; what stands for an event that has no text."""
    return F.btrim(F.concat(F.coalesce(title, F.lit("")), F.lit(" - "), F.coalesce(city, F.lit(""))), F.lit(" -"))


# Wording of the instructions is a parameter of assemble_prompt; this is the library's own default.
DEFAULT_PROMPT = """Tu réponds aux questions sur l'agenda culturel. Date du jour : {date_du_jour}.

Consignes :
- appuie chaque fait (titre, ville, date, description) sur le contexte, sans rien ajouter ;
- ne mentionne aucun événement absent du contexte ;
- si le contexte dit qu'aucun événement n'est disponible, dis-le et propose d'élargir la recherche ;
- sinon, présente les événements en liste à puces, titre en gras, avec la ville et la date.

Contexte :
{context}

Question :
{question}

Réponse :
"""


def assemble_prompt(date_text, context, question, template: str = DEFAULT_PROMPT) -> Column:
    """Fill ``{date_du_jour}``, ``{context}`` and ``{question}`` of a template."""
    return fill_template(template, {"date_du_jour": date_text, "context": context, "question": question})
