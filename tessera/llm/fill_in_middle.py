"""Fill-in-middle examples: the lines of a text are cut at two places and written out of order between sentinels.

All of it is expressions of Spark SQL in one pass without a shuffle. `regexp_extract_all` makes the array of lines, `conv` of
parts of a `sha2` digest of the document's id gives the cuts, `slice` and `array_join` build the arrangement, and `restored`
parses the sentinels to give the text back. A text that holds a sentinel stays as it is, so parsing is never in doubt: parts of
a text without sentinels hold none, and as a sentinel's first character is found nowhere else in it, none arises where a
part and a sentinel meet.

Edge cases: a null text counts as empty, an empty one is plain with no units; a null id is hashed as the empty text; rows alike
in id have the same cuts; a text of any length is one row, with its lines as one array; all columns are kept, and those named
as one of the new ones (fim_...) are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A line with its end, or what follows the last line end.
LINE = r"[^\n]*\n|[^\n]+"
#: Marks before prefix, suffix and middle. Each is to begin with a character that it holds once and end with another.
SENTINELS = ("<P>", "<S>", "<M>")


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """docs (doc_id, text, ...) with fim_units (lines), fim_form (plain, psm or spm), fim_prefix_chars and fim_middle_chars (code points, null if plain)
    and fim_output. rate: percent of the texts that are rearranged; spm: percent of these with the suffix first."""
    p, s, m = (F.lit(x) for x in sentinels)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    # each step is a projection of its own, so that the array of lines is made once
    d = docs.withColumns({"fim_lines": F.regexp_extract_all(text, F.lit(LINE), F.lit(0)), "fim_digest": digest})
    h = [F.conv(F.substring("fim_digest", 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    ways = F.size("fim_lines").cast("long") + 1
    marked = F.greatest(*(F.contains(text, x) for x in (p, s, m)))
    form = F.when((F.size("fim_lines") == 0) | marked | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    d = d.withColumns({"fim_cut": F.array(h[0] % ways, h[1] % ways), "fim_form": form, "fim_units": F.size("fim_lines").cast("long")})
    first, last = F.array_min("fim_cut").cast("int"), F.array_max("fim_cut").cast("int")

    def part(start: Column, n: Column) -> Column:
        return F.array_join(F.slice("fim_lines", start + 1, n), "")

    zero = F.lit(0)
    d = d.withColumns({"fim_prefix": part(zero, first), "fim_middle": part(first, last - first), "fim_suffix": part(last, F.size("fim_lines") - last)})
    split = F.col("fim_form") != "plain"
    psm, spm_text = F.concat(p, "fim_prefix", s, "fim_suffix", m, "fim_middle"), F.concat(s, "fim_suffix", p, "fim_prefix", m, "fim_middle")
    d = d.withColumns({
        "fim_prefix_chars": F.when(split, F.length("fim_prefix").cast("long")), "fim_middle_chars": F.when(split, F.length("fim_middle").cast("long")),
        "fim_output": F.when(F.col("fim_form") == "psm", psm).when(F.col("fim_form") == "spm", spm_text).otherwise(text),
    })
    return d.drop("fim_lines", "fim_digest", "fim_cut", "fim_prefix", "fim_middle", "fim_suffix")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of the given form was made from, from these two alone."""
    p, s, m = sentinels

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        """What stands between `first` and `second`, between `second` and the middle's mark, and after that."""
        a = F.substring_index(F.substring(output, F.lit(len(first) + 1), F.length(output)), second, 1)
        rest = F.substring(output, F.length(a) + len(first) + len(second) + 1, F.length(output))
        b = F.substring_index(rest, m, 1)
        return a, b, F.substring(rest, F.length(b) + len(m) + 1, F.length(rest))

    prefix, suffix, middle = parts(p, s)
    suffix_, prefix_, middle_ = parts(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_, middle_, suffix_)).otherwise(output)
