"""Text layer: normalised names, words, tokens, initials, symbol masks and trigrams.

Names are compared in NFC with full case folding. For ASCII that is lower case, and everything here is a native expression; names with
other symbols go through one Arrow function when entries are built (`layered`), which gives the same columns for them. Rows of
the two kinds are told apart before, so no Python runs on ASCII names.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

NORM_VERSION = 1
#: The separators between words of a name.
SEPARATORS = "/_\\-. \\t\\n\\r"
#: Where a token starts inside a separator-free run: a lower-case letter before an upper-case one, the last capital of an
#: acronym, and between letters and digits.
STARTS = "(?<=\\p{Ll})(?=[\\p{Lu}\\p{Lt}])|(?<=[\\p{Lu}\\p{Lt}])(?=[\\p{Lu}\\p{Lt}]\\p{Ll})|(?<=[\\p{Ll}\\p{Lu}\\p{Lt}\\p{Lm}\\p{Lo}])(?=\\p{Nd})|(?<=\\p{Nd})(?=[\\p{Ll}\\p{Lu}\\p{Lt}\\p{Lm}\\p{Lo}])"
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"


def bound(value: Column, use) -> Column:
    """use(value), with value evaluated once (as a lambda's variable)."""
    return F.transform(F.array(value), use)[0]


def normalised(c: Column) -> Column:
    return F.lower(c)


def fold(text: str) -> str:
    """NFC and full case folding, as names are compared."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold())


@F.pandas_udf(StringType())
def folded(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else fold(x))


def beyond_ascii(c: Column) -> Column:
    return F.coalesce(c.rlike("[^\\x00-\\x7F]"), F.lit(False))


def with_norm(df: DataFrame, text: str, norm: str) -> DataFrame:
    """df with column `norm`: the text as it is compared."""
    odd = beyond_ascii(F.col(text))
    return df.where(~odd).withColumn(norm, normalised(F.col(text))).unionByName(df.where(odd).withColumn(norm, folded(F.col(text))))


#: What layered() adds: the normalised name, its tokens, initials and later runs that change case, and where tokens start.
LAYER = StructType([StructField("norm", StringType()), StructField("toks", ArrayType(StringType())), StructField("inits", StringType()), StructField("cased", ArrayType(StringType())), StructField("starts", ArrayType(IntegerType()))])


def layered(df: DataFrame, name: str = "name") -> DataFrame:
    """df with the columns of LAYER for the text in column `name`."""
    odd, c = beyond_ascii(F.col(name)), F.col(name)
    names = LAYER.names
    df = df.drop(*[n for n in names if n in df.columns and n != name])
    plain = df.where(~odd).select("*", normalised(c).alias("norm"), tokens(c).alias("toks"), initials(c).alias("inits"), cased_runs(c).alias("cased"), boundaries(c).alias("starts"))
    rest = df.where(odd).withColumn("_layer", analysed(c))
    return plain.unionByName(rest.select(*df.columns, *[F.col(f"_layer.{n}").alias(n) for n in names]))


def clusters(text: str) -> list[str]:
    """Symbols with the marks that belong to them, in NFC."""
    out: list[str] = []
    for c in unicodedata.normalize("NFC", text):
        if out and unicodedata.combining(c):
            out[-1] += c
        else:
            out.append(c)
    return out


def analysis(name: str) -> tuple[str, list[str], str, list[str], list[int]]:
    """LAYER of one name: what the native expressions give, for any Unicode text."""
    symbols_ = clusters(name)
    kind = ["sep" if c[0] in "/_-. \t\n\r" else unicodedata.category(c[0]) for c in symbols_]
    upper = lambda k: k in ("Lu", "Lt")
    letter = lambda k: k in ("Ll", "Lu", "Lt", "Lm", "Lo")
    norm, starts, toks, raw, change = [], [], [], [[]], [False]
    for i, (c, k) in enumerate(zip(symbols_, kind)):
        before, after = kind[i - 1] if i else "sep", kind[i + 1] if i + 1 < len(kind) else ""
        cased = (before == "Ll" and upper(k)) or (upper(before) and upper(k) and after == "Ll")
        start = before == "sep" or cased or (letter(before) and k == "Nd") or (before == "Nd" and letter(k))
        low = unicodedata.normalize("NFC", c.casefold())
        norm.append(low)
        starts += [int(start)] + [0] * (len(low) - 1)
        if k == "sep":
            if raw[-1]:
                raw.append([])
                change.append(False)
            continue
        if start:
            toks.append("")
        toks[-1] += low
        raw[-1].append(low)
        change[-1] |= cased
    later = [("".join(r), x) for r, x in zip(raw, change) if r][1:]
    return "".join(norm), toks, "".join(t[0] for t in toks), [r for r, x in later if x], starts


@F.pandas_udf(LAYER)
def analysed(s: pd.Series) -> pd.DataFrame:
    rows = [analysis(x) if x is not None else (None,) * 5 for x in s]
    return pd.DataFrame(rows, columns=LAYER.names)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    """The folder of a path: empty for an entry of the file system's root."""
    return F.regexp_replace(path, "/[^/]*$", "")


def extension(name: Column, is_dir: Column) -> Column:
    """What follows the last dot; null for folders, hidden names without another dot, and names that end in a dot."""
    ext = F.regexp_extract(name, "^.+\\.([^.]+)$", 1)
    return F.when(~is_dir & (ext != ""), ext)


def words(norm: Column) -> Column:
    """The words of a normalised query: split at white space only."""
    return F.filter(F.split(norm, "[ \\t\\n\\r]+"), lambda w: w != "")


def runs(name: Column) -> Column:
    """Separator-free runs of a raw name."""
    return F.filter(F.split(name, f"[{SEPARATORS}]+"), lambda w: w != "")


def raw_tokens(name: Column) -> Column:
    return F.filter(F.split(name, f"[{SEPARATORS}]+|{STARTS}"), lambda w: w != "")


def tokens(name: Column) -> Column:
    return F.transform(raw_tokens(name), normalised)


def initials(name: Column) -> Column:
    """The first symbols of the tokens, joined."""
    return F.array_join(F.transform(tokens(name), lambda t: F.substring(t, 1, 1)), "")


def cased_runs(name: Column) -> Column:
    """Later runs that change case inside, whole and normalised: typed whole they match like a token."""
    later = F.slice(runs(name), 2, F.greatest(F.size(runs(name)) - 1, F.lit(0)))
    change = "(?<=\\p{Ll})(?=[\\p{Lu}\\p{Lt}])|(?<=[\\p{Lu}\\p{Lt}])(?=[\\p{Lu}\\p{Lt}]\\p{Ll})"
    return F.transform(F.filter(later, lambda r: F.size(F.split(r, change)) > 1), normalised)


def boundaries(name: Column) -> Column:
    """For each symbol of the name, whether a token starts there (1) or not (0)."""
    marked = F.regexp_replace(F.regexp_replace(name, STARTS, "\u0001"), f"(?<=[{SEPARATORS}])|^", "\u0001")
    chars = F.split(F.regexp_replace(marked, "\u0001+", "\u0001"), "(?!^)(?<!\u0001)")
    return F.transform(F.filter(chars, lambda c: F.regexp_replace(c, "\u0001", "") != ""), lambda c: c.startswith("\u0001").cast("int"))


def symbols(text: Column) -> Column:
    """The code points of a text, as one-symbol strings."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def symbol_bit(c: Column) -> Column:
    """The mask bit of a symbol: a-z 0 to 25, digits 26 to 35, all others hashed into 36 to 63."""
    at = F.instr(F.lit(LETTERS), c) - 1
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.when((F.length(c) == 1) & (at >= 0), at).otherwise(_hashed(c)))


def _hashed(c: Column) -> Column:
    # the code point times a fixed odd number modulo 2 ** 32, its upper half modulo 28
    code = F.ascii(c).cast("long")
    return (F.shiftright((code * F.lit(2654435761)).bitwiseAND(F.lit(0xFFFFFFFF)), 16) % 28 + 36).cast("int")


def mask(text: Column) -> Column:
    """The OR of a normalised text's symbol bits: a text can hold a word as a subsequence only if its mask holds the word's."""
    return F.aggregate(F.array_distinct(symbols(text)), F.lit(0).cast("long"), lambda m, c: m.bitwiseOR(symbol_bit(c)))


def repeat_mask(text: Column) -> Column:
    """The mask of the symbols that occur twice or more."""
    s = symbols(text)
    return F.aggregate(F.filter(F.array_distinct(s), lambda c: F.size(F.filter(s, lambda x: x == c)) > 1), F.lit(0).cast("long"), lambda m, c: m.bitwiseOR(symbol_bit(c)))


def trigrams(text: Column) -> Column:
    """Distinct windows of three symbols, sorted."""
    n = F.length(text)
    grams = F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(text, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(grams))


def holds(text: Column, word: Column) -> Column:
    """Whether the word's symbols occur in the text in order."""
    pattern = F.array_join(F.transform(symbols(word), lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E"))), ".*")
    return F.regexp_like(text, F.concat(F.lit("(?s)"), pattern))
