"""Cleaning and scalar text functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# What cleaning deletes, in the order in which it is deleted. The entry of two characters stands
# between two runs of single ones, so deletions before it can bring it about and those after it cannot.
REMOVE_FIRST = "』。！，：、（）；？〉〈」「『“”!\"#$%&'()*+,-./0123456789:;<=>?@[\\]_"
REMOVE_PAIR = "`{"
REMOVE_REST = (
    "|}~¤±·×àáèéêìíò"
    "ó÷ùúüāīńňōūǎǐǔǖǘǚǜǹɑɡ"
    "αβγεζηθικλμνξοπρστυφχψω"
    "абвгдекопрстуфхцчшщъыьэюяё"
    "—‖‘’…※ⅰⅲ∈∏∑√∠∥∧∩∪∫∮∶∷∽≈≌≡⊙⊥⌒"
    "①②③④⑤⑥⑦⑧⑨⑩⑴⑵⑶⑷⑸⑹⑺⑻⑼⑽⑾⑿⒀⒁⒂⒃⒄⒅⒆"
    "⒈⒉⒊⒋⒌⒍⒎⒏⒐⒑⒒⒓⒔⒕⒖⒗⒘⒙⒚⒛"
    "─┅┋┌┍┎┏┐┑┒┓└┕┘┙┚┛├┝┞┠┡┢┣┤┥┦┧┩┪┫┬┭┮┯┰┱┲┳"
    "■□▲△◆◇○◎●★︶﹑﹔﹖＂＃％＆＊．／０１２３４５６７８９＜＝＞＠［＼］＿｀"
    "ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ｛｝～￥"
    "abcdefghijklmnopqrstuvwxyz《》〔〕【】ABCDEFGHIJKLMNOPQRSTUV"
    "ＷＸＹＺ＾｜￠￡¶　"
)
KEEP_PUNCTUATION = "，。、？！「」《》"
QUERY_PUNCTUATION = "：。，」「；、 ？！『』"
MARKER = "~BREAK~"
SYLLABLE = "་"

# Members of term categories, tested in this order by substring.
CATEGORIES = (("number", "一二三四五六七八九十百千萬"), ("direction", "東南西北"), ("season", "春夏秋冬"), ("animal", "狗犬貓熊鵝鳥蛇豹蝦蚵蝎蟲馬牛螞蟻蜂虎蚊獸禽雞鵲羊驢象魚蛙鴿"))


def delete_chars(c: Column, chars: str) -> Column:
    return F.translate(c, chars, "") if chars else c


def clean(c: Column, whitespace: bool = True, newlines: bool = True, other: tuple[str, ...] = (), keep_punctuation: bool = False, keep_paragraphs: bool = False, blanks: bool = False) -> Column:
    """White space, newlines, blanks, markers, tags, further patterns and the fixed characters, in this order."""
    if whitespace:
        c = F.regexp_replace(c, r"(?U)\s+", "")
    if newlines:
        if keep_paragraphs:
            mark = "***doublegraph***"
            c = F.replace(F.replace(F.replace(c, F.lit("\n\n"), F.lit(mark)), F.lit("\n"), F.lit("")), F.lit(mark), F.lit("\n"))
        else:
            c = F.replace(c, F.lit("\n"), F.lit(""))
    if blanks:
        c = delete_chars(c, " \t")
    c = F.replace(c, F.lit(MARKER), F.lit(""))
    c = F.replace(F.regexp_replace(c, r"(?d)<.+?>", ""), F.lit("¶"), F.lit(""))
    for pattern in other:
        c = F.regexp_replace(c, pattern, "")
    keep = set(KEEP_PUNCTUATION) if keep_punctuation else set()
    c = delete_chars(c, "".join(x for x in REMOVE_FIRST if x not in keep))
    c = F.replace(c, F.lit(REMOVE_PAIR), F.lit(""))
    return delete_chars(c, "".join(x for x in REMOVE_REST if x not in keep))


def strip_query(c: Column) -> Column:
    return delete_chars(c, QUERY_PUNCTUATION)


def target_tokens(c: Column, drop_empty: bool = True) -> Column:
    """Syllable marks before a space or at the end go; words are split at single spaces."""
    c = F.regexp_replace(F.replace(c, F.lit(SYLLABLE + " "), F.lit(" ")), SYLLABLE + "$", "")
    words = F.split(c, " ")
    return F.filter(words, lambda w: w != "") if drop_empty else words


#: Pieces whose lengths are summed in one fold; folds append, so long ones would take quadratic time.
FOLD = 256


def running_sums(lengths: Column) -> Column:
    """Running sums of an array of numbers: by folds of FOLD numbers, moved by the sums of the folds before."""
    none = F.expr("cast(array() as array<int>)")

    def running(x: Column, first: Column) -> Column:
        return F.aggregate(x, F.struct(first.alias("sum"), none.alias("out")), lambda s, n: F.struct((s["sum"] + n).alias("sum"), F.concat(s["out"], F.array(s["sum"] + n)).alias("out")))["out"]

    folds = F.ceil(F.size(lengths) / F.lit(FOLD)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.greatest(folds, F.lit(1)) - 1), lambda k: F.slice(lengths, k * FOLD + 1, F.lit(FOLD)))
    whole = running(F.transform(parts, lambda x: F.aggregate(x, F.lit(0), lambda s, n: s + n)), F.lit(0))
    first = F.concat(F.array(F.lit(0)), whole)
    return F.flatten(F.zip_with(parts, F.slice(first, F.lit(1), F.size(parts)), lambda x, at: running(x, at)))


def find_all(term: Column, text: Column) -> Column:
    """Start offsets, overlaps too; null if there are none or the term is empty. The text is cut once before each
    occurrence; an occurrence stands where a piece ends, and at 0 if the text begins with the term."""
    pieces = F.split(text, F.concat(F.lit("(?=\\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)")))
    none = F.expr("cast(array() as array<int>)")
    ends = running_sums(F.transform(pieces, lambda p: F.length(p)))
    found = F.concat(F.when(F.startswith(text, term), F.array(F.lit(0))).otherwise(none), F.filter(F.slice(ends, F.lit(1), F.size(ends) - 1), lambda at: at > 0))
    return F.when(F.length(term) > 0, F.nullif(found, none))


def remove_repeatedly(c: Column, what: str) -> Column:
    """``what`` becomes a space, again and again until none is left. Only a ``what`` with a space in it can come about anew;
    each round then shortens the text, so it ends."""
    if what in ("", " "):
        raise ValueError("this would never end")
    if " " not in what:
        return F.replace(c, F.lit(what), F.lit(" "))

    @F.arrow_udf("string")
    def removed(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            while t is not None and what in t:
                t = t.replace(what, " ")
            out.append(t)
        return pa.array(out, pa.string())

    return removed(c)


def category(term: Column) -> Column:
    out = None
    for name, members in CATEGORIES:
        test = F.contains(F.lit(members), term)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("other")


def gloss(first: Column, second: Column, glosses: dict[str, str]) -> tuple[Column, Column]:
    """Labels of a pair of terms: each with its gloss behind it, the second with the first's where it has none of its own;
    both are empty where the first has no gloss."""
    known = F.create_map(*[F.lit(x) for kv in glosses.items() for x in kv]) if glosses else F.expr("cast(map() as map<string, string>)")
    one, two = F.try_element_at(known, first), F.try_element_at(known, second)
    return F.when(one.isNull(), F.lit("")).otherwise(F.concat(first, one)), F.when(one.isNull(), F.lit("")).otherwise(F.concat(second, F.coalesce(two, one)))


def simplify(c: Column, mapping: dict[str, str]) -> Column:
    """Traditional to simplified by a given mapping of single characters."""
    return F.translate(c, "".join(mapping), "".join(mapping.values()))


def with_stars(words: Column, begin: Column, length: Column) -> Column:
    """Three stars before and after ``length`` words from ``begin``, an index from 0."""
    star = F.array(F.lit("***"))
    head, body = F.slice(words, F.lit(1), begin), F.slice(words, begin + 1, length)
    rest = F.slice(words, begin + length + 1, F.greatest(F.size(words) - begin - length, F.lit(0)))
    return F.concat(head, star, body, star, rest)
