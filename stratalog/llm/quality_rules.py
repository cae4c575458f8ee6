"""Quality rules, line first, with DataFrame functions only.

Each line of a document is judged by itself: sentence punctuation, navigation, boilerplate, symbols and shouting. Lines that
fail go. A document that loses more than `max_loss` of its words with them is rejected, and so is one that fails the base
rules on its length and its repeats.

Lines are parted by line feeds; lines without a word neither fail nor count. Defined cases: a null text is empty. Empty texts
have no words and fail the base rules. Very long lines and texts are judged whole; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import WORD, fresh

MAX_LOSS = 0.5
ANY_WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
#: A word that ends a sentence, a quotation or a clause; a line of several words has one.
SENTENCE_END = r"[.!?:;)\]\"'…。！？»”’](?:$|[\x20\x09-\x0D])"
NAVIGATION = r"(?i)^[\x20\x09-\x0D]*(?:home|about(?: us)?|contact(?: us)?|log ?in|sign (?:in|up)|register|next|previous|back to top|read more|share(?: this)?|menu|search|skip to content|site ?map|faq|help|tags?:.*|categor(?:y|ies):.*|posted (?:in|by|on) .*|page [0-9]+(?: of [0-9]+)?|startseite|[uü]ber uns|kontakt|anmelden|registrieren|weiterlesen|zur[uü]ck|nach oben|teilen|suche|accueil|[aà] propos|contactez-nous|connexion|s'inscrire|lire la suite|suivant|pr[eé]c[eé]dent|haut de page|partager|rechercher|inicio|acerca de|contacto|iniciar sesi[oó]n|registrarse|leer m[aá]s|siguiente|anterior|volver arriba|compartir|buscar)[\x20\x09-\x0D]*$"
SEPARATORS = r"(?:^|[\x20\x09-\x0D])(?:[|>»·•/]|&gt;|&raquo;)(?:$|[\x20\x09-\x0D])"
BOILERPLATE = r"(?i)all rights reserved|terms of (?:use|service)|privacy policy|cookies? policy|we use cookies|enable javascript|javascript is (?:disabled|required)|lorem ipsum|click here|subscribe to our|powered by|follow us on|alle rechte vorbehalten|datenschutzerkl[aä]rung|nutzungsbedingungen|cookie-richtlinie|wir verwenden cookies|hier klicken|tous droits r[eé]serv[eé]s|politique de confidentialit[eé]|conditions d'utilisation|nous utilisons des cookies|cliquez ici|todos los derechos reservados|pol[ií]tica de privacidad|t[eé]rminos de uso|utilizamos cookies|haga clic aqu[ií]"


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def line_fails(line: Column, n_words: Column) -> Column:
    """Whether a line of n_words words (1 or more) fails a rule."""
    symbols = F.regexp_count(line, F.lit(SYMBOLS + r"|[{}]"))
    return (
        ((n_words >= 5) & ~line.rlike(SENTENCE_END))
        | (F.regexp_count(line, F.lit(SEPARATORS)) * 4 >= F.greatest(n_words, F.lit(8)))
        | (2 * symbols >= n_words)
        | ((F.regexp_count(line, F.lit("!!")) * 2 >= n_words))
        | line.rlike(NAVIGATION)
        | line.rlike(BOILERPLATE)
    )


def repeat_words(df: DataFrame, words: str, name: str) -> DataFrame:
    """df with the number of words that lie in a window of three words found twice or more in the array `words`.

    Windows are compared by a 64-bit hash. Only texts with an equal pair sort theirs, with their places; neighbours that are
    equal are repeats, and the repeats' places, in order, each cover three words less what the next one covers.
    """
    hashes, order, places = fresh(df, "rw_hashes", "rw_order", "rw_places")
    n = F.size(words)
    window = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    out = df.withColumn(hashes, F.when(n >= 3, window))
    some = F.size(hashes) > F.size(F.array_distinct(hashes))
    out = out.withColumn(order, F.when(some, F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter(order, lambda e, k: (F.get(order, k - 1)["h"] == e["h"]).eqNullSafe(True) | (F.get(order, k + 1)["h"] == e["h"]).eqNullSafe(True))
    out = out.withColumn(places, F.sort_array(F.transform(twice, lambda e: e["i"])))
    covered = F.aggregate(F.transform(places, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - i, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return out.withColumn(name, F.coalesce(covered, F.lit(0)).cast("long")).drop(hashes, order, places)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept_words", "kept_lines", "kept")


def judge(docs: DataFrame, text: str = "text", max_loss: float = MAX_LOSS, names: tuple[str, ...] = NAMES) -> DataFrame:
    """docs with the columns `names`: the measures, the base rules' verdict, the words and lines that stay, and the verdict."""
    n_words, word_chars, n_symbols, n_dup, n_repeat, base_failed, kept_words, kept_lines, kept = fresh(docs, *names)
    words, lines, judged = fresh(docs, "qr_words", "qr_lines", "qr_judged")
    out = docs.withColumn(words, words_of(F.col(text)))
    out = out.withColumn(n_words, F.size(words).cast("long")).withColumn(word_chars, F.length(F.array_join(words, "")).cast("long"))
    out = repeat_words(out, words, n_repeat).drop(words)
    out = out.withColumn(n_symbols, F.coalesce(F.regexp_count(F.col(text), F.lit(SYMBOLS)), F.lit(0)).cast("long"))
    out = out.withColumn(lines, F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda x: x.rlike(ANY_WORD)))
    out = out.withColumn(n_dup, (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))
    out = out.withColumn(judged, F.transform(F.transform(lines, lambda x: F.struct(x.alias("line"), F.regexp_count(x, F.lit(WORD)).alias("n"))), lambda s: F.struct(s["line"].alias("line"), s["n"].alias("n"), line_fails(s["line"], s["n"]).alias("fails"))))
    out = out.withColumn(judged, F.filter(judged, lambda s: ~s["fails"]))
    out = out.withColumn(kept_words, F.aggregate(judged, F.lit(0).cast("long"), lambda a, s: a + s["n"])).withColumn(kept_lines, F.transform(judged, lambda s: s["line"])).drop(judged, lines)
    out = out.withColumn(base_failed, (F.col(n_words) < 50) | (100 * F.col(n_repeat) > 50 * F.col(n_words)))
    return out.withColumn(kept, ~F.col(base_failed) & (F.col(n_words) - F.col(kept_words) <= F.lit(max_loss) * F.col(n_words)))


def clean(docs: DataFrame, text: str = "text", max_loss: float = MAX_LOSS) -> DataFrame:
    """The documents that stay, their text with the failing lines removed; n_chars, if there is one, follows.

    The measures are one value that a generator hands on, so that the filter on the verdict does not repeat them.
    """
    names = tuple(fresh(docs, *(f"qr_{n}" for n in NAMES)))
    (once,) = fresh(docs, "qr_once")
    judged = judge(docs, text, max_loss, names)
    kept = F.when(F.col(names[-1]), F.array(F.struct(F.array_join(names[-2], "\n").alias("text"))))
    out = judged.select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(kept).alias(once))
    out = out.withColumn(text, F.col(f"{once}.text")).drop(once)
    return out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
