"""Rules over queries, answers and classifications as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions import text as T

# Words that a rewritten query drops, synonyms and templates of expansions.
STOP = ("please", "plz", "could", "would", "should", "tell", "me", "about", "the", "a", "an", "hi", "hello", "thanks", "thank", "you", "help", "need", "how", "what", "which", "that", "this")
TEMPLATES = ("explain {q}", "overview of {q}")
SYNONYMS = {
    "insurance": ("coverage", "policy"), "financial": ("monetary", "economic"), "loss": ("damage", "liability"), "company": ("corporate", "business"),
    "pension": ("retirement", "annuity"), "error": ("mistake", "negligence"), "document": ("file", "pdf"),
}
# Keywords of each intent, in the order in which equal scores are decided.
INTENTS = {
    "advice": ("was ist", "wie funktioniert", "erklären", "bedeutung", "definition", "beratung", "hilfe", "verstehen", "frage", "info", "information", "erkläre mir", "was bedeutet", "wie geht", "warum", "wieso", "unterschied", "vergleich", "vorteile", "nachteile", "kosten"),
    "application": ("antrag", "beantragen", "versicherung abschließen", "anmelden", "daten eingeben", "persönliche angaben", "vertrag", "abschluss", "möchte versicherung", "will beantragen", "antrag stellen", "anmeldung", "vertragsabschluss", "police", "abschließen"),
    "risk": ("risikoprüfung", "gesundheit", "vorerkrankung", "beruf risiko", "gefährlich", "risikobewertung", "voranfrage", "prüfung", "risiko", "gesundheitsfragen", "vorerkrankungen", "berufskrankheit", "gefährdung", "risikofaktoren", "gesundheitscheck"),
    "oos": ("wetter", "politik", "sport", "nachrichten", "kochrezept", "allgemein", "nicht versicherung", "auto", "kfz", "hausrat", "lebensversicherung", "krankenversicherung", "reiseversicherung", "tierversicherung", "rechtschutz"),
}
# Required fields of an intent with their questions, patterns of fields, and words of risk with their points.
QUESTIONS = {
    "application": {"geburtsdatum": "Bitte nennen Sie Ihr Geburtsdatum (TT.MM.JJJJ):", "beruf": "Welchen Beruf üben Sie aktuell aus?", "jahreseinkommen": "Wie hoch ist Ihr jährliches Bruttoeinkommen?", "versicherungssumme": "Welche monatliche BU-Rente wünschen Sie?"},
    "risk": {"beruf": "Welchen Beruf üben Sie aus?", "gesundheitsangaben": "Haben Sie Vorerkrankungen oder Beschwerden?", "hobbys_risiken": "Üben Sie risikoreiche Hobbys oder Sportarten aus?"},
}
DATE, NUMBER = r"\d{1,2}\.\d{1,2}\.\d{4}", r"\d+\.?\d*"
RISKS = ((3, ("pilot", "bergsteiger", "polizist", "feuerwehr", "bauarbeiter")), (2, ("diabetes", "herz", "krebs", "depression", "rücken")), (2, ("fallschirm", "klettern", "motor", "boxen", "ski")))
NUMERIC = r"(?<![\p{L}\p{N}_/])(\d{1,4}(?:[.,]\d{3})*(?:[.,]\d+)?)(?![\p{L}\p{N}_/])"
NEGATION, UNCERTAIN = r"\b(not|no|never|unlikely|false)\b", r"\b(might|may|possibly|uncertain|unknown)\b"
_QUERY_WORD = r"[A-Za-zÀ-ÖØ-öø-ÿ0-9\-]+"


def words_in(text: Column, words: tuple) -> Column:
    """How many of the words a lower-cased text contains."""
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))


def rewrite(text: Column) -> Column:
    """Telling words of a turn's last clause, each once, 24 at most; if none, the clause's first 200 characters."""
    bare = T.strip(F.regexp_replace(T.strip(text), r"(?i)^(hi|hello|hey)[,!\s]*", ""))
    clauses = F.filter(F.transform(F.split(bare, r"[.?!;\n]+"), T.strip), lambda c: c != "")
    last = F.when(F.size(clauses) > 0, F.element_at(clauses, -1)).otherwise(bare)
    words = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(last, F.lit(_QUERY_WORD), F.lit(0)), F.lower), lambda w: ~w.isin(*STOP) & (F.length(w) > 1)))
    return F.when(F.size(words) > 0, F.array_join(F.slice(words, 1, 24), " ")).otherwise(F.left(last, F.lit(200)))


def expand(query: Column, n: int = 2) -> Column:
    """array<string>: the templates, then the query with single words swapped for synonyms; distinct, max(2, n) of them."""
    q = F.regexp_replace(T.strip(query), r"\s+", " ")
    plain = [F.concat(F.lit(t.split("{q}")[0]), q, F.lit(t.split("{q}")[1])) for t in TEMPLATES]
    words = F.regexp_extract_all(F.lower(q), F.lit(_QUERY_WORD), F.lit(0))
    table = F.create_map(*(x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    swapped = F.flatten(F.transform(words, lambda w, i: F.transform(F.coalesce(F.try_element_at(table, w), F.array().cast("array<string>")), lambda s: F.array_join(F.transform(words, lambda x, j: F.when(i == j, s).otherwise(x)), " "))))
    both = F.concat(F.array(*plain), F.slice(swapped, 1, max(0, max(4, n * 2) - len(TEMPLATES))))
    return F.slice(F.array_distinct(F.filter(both, lambda x: x != "")), 1, max(2, n))


def intent(text: Column) -> Column:
    """struct<intent, confidence>: the largest share of an intent's keywords, doubled, 0.9 at most; without any: advice, 0.1."""
    low = F.lower(text)
    scored = F.array(*(F.struct(F.round(words_in(low, w) / len(w), 12).alias("score"), F.lit(-i).alias("order"), F.lit(k).alias("intent")) for i, (k, w) in enumerate(INTENTS.items())))
    best = F.array_max(scored)
    return F.when(best["score"] > 0, F.struct(best["intent"].alias("intent"), F.least(best["score"] * 2, F.lit(0.9)).alias("confidence"))).otherwise(F.struct(F.lit("advice").alias("intent"), F.lit(0.1).alias("confidence")))


def route(found: Column, threshold: float = 0.8, fallback: bool = True) -> Column:
    """The intent, or under the threshold the default one."""
    return F.when(found["confidence"] < threshold, "advice" if fallback else "oos").otherwise(found["intent"])


def fields(text: Column, name: str) -> dict[str, Column]:
    """Fields of an intent that a text gives; null where it doesn't. Both money fields take the first number."""
    low = F.lower(text)
    match = lambda p: F.nullif(F.regexp_extract(text, f"({p})", 1), F.lit(""))
    words = T.words(text)
    at = F.array_position(F.transform(words, F.lower), F.lit("als"))
    named = (F.contains(low, F.lit("beruf")) | F.contains(low, F.lit("arbeite als"))) & (at > 0) & (at < F.size(words))
    job = F.when(named, F.array_join(F.slice(words, F.greatest(at, F.lit(1)).cast("int") + 1, F.lit(2)), " "))
    if name == "application":
        return {"geburtsdatum": match(DATE), "beruf": job, "jahreseinkommen": match(NUMBER), "versicherungssumme": match(NUMBER)}
    return {"beruf": job, "gesundheitsangaben": F.lit(None).cast("string"), "hobbys_risiken": F.lit(None).cast("string")}


def risk(job: Column, health: Column, hobbies: Column) -> Column:
    """Points of the words in each field, ten at most."""
    parts = zip(RISKS, (job, health, hobbies), strict=True)
    points = [F.when(words_in(F.lower(F.coalesce(c, F.lit(""))), w) > 0, p).otherwise(0) for (p, w), c in parts]
    return F.least(F.lit(10), points[0] + points[1] + points[2])


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits, from the largest down so that none overflows."""
    top = F.array_max(logits)
    powers = F.zip_with(logits, F.array_repeat(top, F.size(logits)), lambda x, t: F.exp(x - t))
    total = F.aggregate(powers, F.lit(0.0), lambda s, x: s + x)
    return F.zip_with(powers, F.array_repeat(total, F.size(logits)), lambda p, t: p / t)


def retry_delay(attempt: Column, base: float = 1.0, most: float = 60.0) -> Column:
    """min(base * 2^attempt, most) seconds, before jitter."""
    return F.least(F.lit(most), base * F.pow(F.lit(2.0), attempt))


def citation_ok(paragraph: Column, sources: Column) -> Column:
    """Whether a paragraph ends with source numbers in brackets that all exist."""
    inner = F.regexp_extract(paragraph, r"\[(\d+(?:\s*,\s*\d+)*)\]$", 1)
    numbers = F.transform(F.split(inner, ","), lambda x: F.trim(x).cast("int"))
    return (inner != "") & F.forall(numbers, lambda n: (n >= 1) & (n <= sources))
