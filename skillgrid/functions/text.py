"""Text columns: name cleaning, trimming and the leadership pattern."""

from __future__ import annotations

from unicodedata import combining, normalize

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACES = " \t\n\x0b\x0c\r"
# The terms of leadership titles and the letters that bound them.
LEADERSHIP_TERMS = ("jefe", "gerente", "director", "directora", "líder", "lider", "supervisor", "supervisora", "chief", "head of", "team lead")
_LETTERS = "a-záéíóúüñ0-9"
LEADERSHIP = rf"(?i)^.*(^|[^{_LETTERS}])({'|'.join(LEADERSHIP_TERMS)})($|[^{_LETTERS}]).*$"
#: The blocks of Latin letters, and those of combining marks.
LATIN = (*range(0xA0, 0x250), *range(0x1E00, 0x1F00))
_MARKS = "[̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯]"


def _folds() -> dict[str, str]:
    """Every lower-case letter of the Latin blocks that compatibility decomposition without marks changes."""
    out = {}
    for c in map(chr, LATIN):
        if c == c.lower():
            plain = "".join(x for x in normalize("NFKD", c) if not combining(x))
            if plain != c:
                out[c] = plain
    return out


_FOLDS = _folds()
_ONE = {c: p for c, p in _FOLDS.items() if len(p) == 1}
_MORE = {c: p for c, p in _FOLDS.items() if len(p) != 1}


def is_leadership(title: str) -> Column:
    """Whether a whole term stands in the title; letters' case doesn't matter for a-z."""
    return F.col(title).rlike(LEADERSHIP)


def tidy(title: str) -> Column:
    """Lower-cased, without white space around it."""
    return F.lower(F.btrim(F.col(title), F.lit(_SPACES)))


def folded(text: Column) -> Column:
    """Lower case, Latin letters without accents as compatibility decomposition gives them, no combining marks."""
    plain = F.lower(text)
    # Letters that become several are rare: only texts that hold one are gone through for each.
    several = plain
    for c, p in _MORE.items():
        several = F.replace(several, F.lit(c), F.lit(p))
    plain = F.when(plain.rlike("[" + "".join(_MORE) + "]"), several).otherwise(plain)
    return F.regexp_replace(F.translate(plain, "".join(_ONE), "".join(_ONE.values())), _MARKS, "")


def clean(name: str) -> Column:
    """Folded, other signs as spaces, single-spaced."""
    return F.btrim(F.regexp_replace(folded(F.col(name).cast("string")), r"[^a-z0-9]+", " "))
