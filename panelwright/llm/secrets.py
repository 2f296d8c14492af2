"""Secrets in documents: a wide search for candidates, then a random forest against false findings.

Candidates are long runs of key characters that hold a digit, and whatever is assigned to a secret's
name or follows the word Bearer. The forest reads their shape (length, kinds of characters and how
often they change, vowels), how much of them is made of dictionary words, the path of the name they
are assigned to, and the words around. It is trained from labelled findings, or from what ``evidence``
says of the corpus's own candidates and of variants of them. Everything is DataFrame expressions; the
forest is trained and applied on the JVM.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.scratch import pin

# Parts of names that hold secrets, words that speak against one, the beginnings of
# common key formats, and dictionary words that stand in placeholders and ordinary identifiers.
SECRET_NAMES = (
    "token|secret|passw(?:or)?d|pwd|api_?key|access_?key|private_?key|auth(?!or(?!iz))|credential|bearer|signature"
)
HARMLESS_NAMES = "sha\\d*|md5|checksum|digest|commit|revision|uuid|guid|version|build|order|invoice|isbn|card|phone|serial"
KEY_FORMATS = r"^(?:AKIA[0-9A-Z]{16}$|gh[pousr]_\w{30,}|xox[abpr]-|sk[-_]\w{16,}|eyJ[\w\-]{10,}|AIza[\w\-]{30,})"
_FORMS = "array<struct<candidate:string,before:string,after:string,label:double>>"
DICTIONARY = (
    "example sample test dummy fake placeholder change your insert secret token password key value data user name "
    "file image page index default build release version http https www com org html json xml node config the and"
).split()

KEY_CHARS = r"A-Za-z0-9+/_\-"
#: A whole run of at least 16 key characters with a digit among them.
RUN = rf"(?<![{KEY_CHARS}])(?=[A-Za-z+/_\-]*[0-9])[{KEY_CHARS}]{{16,}}"
#: A secret's name with a sign of assignment, or Bearer before 16 characters that are no blanks.
LEAD = (
    rf"(?i:(?:{SECRET_NAMES})[\w.\-]{{0,40}}[\"']?\s{{0,4}}(?:=>|:=|[:=])\s{{0,4}}(?!bearer\s)[\"']?"
    r"|\bbearer\s{1,4}(?=\S{16}))"
)
#: What such a lead introduces: at least eight characters up to a blank, quote, bracket or separator.
VALUE = r"[^\s\"',;<>(){}\[\]]{7,}[^\s\"',;<>(){}\[\].!?:]"
CANDIDATE = f"{LEAD}{VALUE}|{RUN}"
#: Labelled findings that the forest learns from, at most, by the smallest hashes.
TRAIN_ROWS = 20_000
TREES, DEPTH = 20, 8
THRESHOLD = 0.5
#: Characters before and after a candidate in which names and words are sought.
BEFORE, AFTER = 120, 60
#: Bits of a character from which a value counts as random, and characters before it that may name it.
RANDOM_BITS, NAMED_WITHIN = 2.5, 40

FEATURES = (
    "length digits uppers lowers symbols kinds distinct_chars transitions vowels consonant_runs hex_only digits_only "
    "dictionary_share has_name secret_name harmless_name bearer_before name_depth quoted secret_words "
    "harmless_words sentence_before"
).split()


def candidates(documents: DataFrame) -> DataFrame:
    """(doc_id, nth, candidate, before, after): every candidate of every text with its surroundings.

    The surroundings are those of the text, other candidates included. A match is at least 14
    characters long, so nine matches and what lies between them cover the widest of them.
    """
    found = documents.where(F.col("text").rlike(CANDIDATE)).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("found"),
        F.split("text", CANDIDATE, -1).alias("rest"),
    )
    near = BEFORE // 14 + 1
    # Ends and beginnings of what lies between, each with the match that follows or precedes it.
    ends = F.zip_with("rest", "found", lambda r, x: F.concat(F.right(r, F.lit(BEFORE)), F.right(F.coalesce(x, F.lit("")), F.lit(BEFORE))))
    starts = F.zip_with("found", F.slice("rest", 2, F.size("found")), lambda x, r: F.concat(F.left(x, F.lit(AFTER)), F.left(r, F.lit(AFTER))))
    found = found.withColumns({"ends": ends, "starts": starts})

    def around(x: Column, k: Column) -> Column:
        value = F.regexp_replace(x, f"^{LEAD}(?={VALUE}$)", F.lit(""))
        lead = F.left(x, F.length(x) - F.length(value))
        first = F.greatest(k - near, F.lit(0))
        behind = F.array_join(F.slice("ends", first + 1, k - first), "")
        ahead = F.array_join(F.slice("starts", k + 2, F.lit(near)), "")
        return F.struct(
            k.cast("int").alias("nth"),
            value.alias("candidate"),
            F.right(F.concat(behind, F.right(F.get("rest", k), F.lit(BEFORE)), lead), F.lit(BEFORE)).alias("before"),
            F.left(F.concat(F.left(F.get("rest", k + 1), F.lit(AFTER)), ahead), F.lit(AFTER)).alias("after"),
        )

    return found.select("doc_id", F.inline(F.transform("found", around)))


def _share(pattern: str) -> Column:
    return F.regexp_count("candidate", F.lit(pattern)) / F.length("candidate")


def with_features(found: DataFrame) -> DataFrame:
    """Candidates with the columns of ``FEATURES``, all double."""
    name = F.regexp_extract("before", r"([A-Za-z][\w.\-]*)[\"']?\s*(?:=>|:=|[:=])\s*[\"']?$", 1)
    letters = F.regexp_extract_all(F.lower("candidate"), F.lit("[a-z]{3,}"), F.lit(0))
    covered = F.aggregate(
        F.filter(letters, lambda run: F.array_contains(F.array(*map(F.lit, DICTIONARY)), run)),
        F.lit(0),
        lambda total, run: total + F.length(run),
    )
    columns = {
        "length": F.length("candidate"),
        "digits": _share("[0-9]"),
        "uppers": _share("[A-Z]"),
        "lowers": _share("[a-z]"),
        "symbols": _share("[^A-Za-z0-9]"),
        "kinds": sum(F.col("candidate").rlike(k).cast("int") for k in ("[0-9]", "[A-Z]", "[a-z]", "[^A-Za-z0-9]")),
        "distinct_chars": F.size(F.array_distinct(F.split("candidate", ""))),
        "transitions": _share("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])"),
        "vowels": _share("(?i)[aeiou]"),
        "consonant_runs": _share("(?i)[b-df-hj-np-tv-xz]{4}"),
        "hex_only": F.col("candidate").rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"),
        "digits_only": F.col("candidate").rlike("^[0-9]+$"),
        "dictionary_share": covered / F.length("candidate"),
        "has_name": F.length(name) > 0,
        "secret_name": name.rlike(f"(?i){SECRET_NAMES}"),
        "harmless_name": name.rlike(f"(?i){HARMLESS_NAMES}"),
        "bearer_before": F.col("before").rlike(r"(?i)\bbearer\s+$"),
        "name_depth": F.regexp_count(name, F.lit(r"[._\-]")),
        "quoted": F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']"),
        "secret_words": F.regexp_count(F.concat_ws(" ", "before", "after"), F.lit(f"(?i)\\b(?:{SECRET_NAMES})\\b")),
        "harmless_words": F.regexp_count(F.concat_ws(" ", "before", "after"), F.lit(f"(?i)\\b(?:{HARMLESS_NAMES})\\b")),
        "sentence_before": F.col("before").rlike(r"[.!?]\s+$"),
    }
    return found.withColumns({k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in columns.items()})


def bits(text: Column) -> Column:
    """Entropy of a text's characters, in bits a character; 0 for an empty text."""
    size = F.length(text)
    each = F.transform(F.array_distinct(F.split(text, "")), lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size)
    return F.coalesce(F.aggregate(each, F.lit(0.0), lambda total, p: total - F.when(p > 0, p * F.log2(p)).otherwise(0.0)), F.lit(0.0))


def evidence(found: DataFrame) -> DataFrame:
    """Label findings by what the forest does not read: entropy, key formats, and a name at some distance.

    The tables hold no reviewed findings, so this stands in for them; ``find_secrets`` takes any. A
    finding is a secret if it begins like a key of a known format, or if it has 16 characters of random
    looks that are not all digits, and a secret's name stands shortly before it, quoted or not.
    """
    named = F.right("before", F.lit(NAMED_WITHIN)).rlike(f"(?i){SECRET_NAMES}") & (F.col("harmless_name") == 0)
    random = (F.length("candidate") >= 16) & (bits(F.col("candidate")) >= RANDOM_BITS) & ~F.col("candidate").rlike("^[0-9]+$")
    secret = F.col("candidate").rlike(KEY_FORMATS) | (random & named & (F.col("dictionary_share") <= 0.3))
    return found.withColumn("label", secret.cast("double"))


def variants(findings: DataFrame) -> DataFrame:
    """Labelled findings as they stand and in other forms that keep or lose their label.

    A corpus shows few ways to write a secret. Each finding is repeated without quotes, after Bearer,
    cut to twelve characters, and with letters for digits, all with its label. A secret is also
    repeated with its hash in mixed letters as the value, long and short, with and without quotes; and,
    as what is no secret, with placeholders and a word of its surroundings in its place.
    """
    bare_before = F.regexp_replace("before", "[\"']$", "")
    bare_after = F.regexp_replace("after", "^[\"']", "")
    value, label = F.col("candidate"), F.col("label")
    mixed = F.translate(F.base64(F.unhex(F.sha2(value, 256))), "=", "")
    letters = F.translate(mixed, "0123456789+/", "gHjKmNpQrStV")
    word = F.regexp_extract(F.concat_ws(" ", "after", "before"), r"\b([A-Za-z]{8,})\b", 1)

    def form(candidate: Column, before: Column | str, after: Column | str, label: Column) -> Column:
        before, after = (F.col(x) if isinstance(x, str) else x for x in (before, after))
        return F.struct(candidate.alias("candidate"), before.alias("before"), after.alias("after"), label.alias("label"))

    same = [
        form(value, "before", "after", label),
        form(value, bare_before, bare_after, label),
        form(value, F.lit("Authorization: Bearer "), bare_after, label),
        form(F.left(value, F.lit(12)), "before", "after", label),
        form(F.translate(value, "0123456789", "ghjkmnpqrs"), "before", "after", label),
    ]
    quotes = (("before", "after"), (bare_before, bare_after))
    short = F.left(mixed, F.lit(9))
    marked = F.overlay(short, F.lit("!"), F.lit(5))
    secret = [form(v, b, a, label) for v in (mixed, letters, short, marked) for b, a in quotes]
    fakes = [F.lit(x) for x in ("changeme", "your_token_here", "example-secret-value", "xxxxxxxxxxxxxxxx")]
    harmless = [form(v, b, a, F.lit(0.0)) for v in [*fakes, word] for b, a in quotes]
    forms = F.concat(F.array(*same), F.when(label == 1, F.array(*secret, *harmless)).otherwise(F.array().cast(_FORMS)))
    return findings.select(F.inline(forms)).where(F.length("candidate") >= 8)


def find_secrets(documents: DataFrame, findings: DataFrame | None = None, *, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, nth, candidate, score, secret), one row for every candidate of every document.

    ``nth`` numbers a document's candidates from 0 in the order of the text; ``score`` is the forest's
    chance that the candidate is a secret. ``findings`` holds labelled candidates (candidate, before,
    after, label); without it the candidates are labelled by ``evidence`` and learned from with their
    ``variants``. At most ``rows`` findings are learned from. Where labels are all alike, the score is that label; without any it is 0. Null and
    empty texts have no candidates; a null id passes through; repeated rows give their candidates
    each. An empty table gives an empty result; other columns are not read.
    """
    found = pin(with_features(candidates(documents)), "candidates")
    own = findings is None
    labelled = evidence(found) if own else findings.where("label IS NOT NULL")
    picked = (
        labelled.select("candidate", "before", "after", F.col("label").cast("double").alias("label"))
        .orderBy(F.xxhash64("before", "candidate", "after"), "before", "candidate", "after", "label")
        .limit(rows)
    )
    sample = pin(with_features(variants(picked) if own else picked).select(*FEATURES, "label"), "findings")
    classes = [r.label for r in sample.select("label").distinct().limit(3).collect()]
    if len(classes) < 2:
        score = F.lit(float(classes[0]) if classes else 0.0)
    else:
        assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
        forest = RandomForestClassifier(
            labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=7
        ).fit(assembler.transform(sample).select("features", "label"))
        found = forest.transform(assembler.transform(found))
        score = vector_to_array("probability")[1]
    return found.withColumn("score", score).select(
        "doc_id", "nth", "candidate", "score", (F.col("score") >= THRESHOLD).alias("secret")
    )
