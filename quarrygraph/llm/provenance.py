"""Problem 5: generated, minified, vendored and bulk-data source files.

A random forest on measures of the content (compression ratio, entropy of tokens, lengths of identifiers, density of
comments, variety of line forms and the like) tells produced files from hand-written ones. It is fitted on a bounded
sample of at most ``TRAINING_ROWS`` rows, labelled by what files state of themselves: notices of generators and
minifiers in the head, and names that such tools give. The notices are cut off before measuring and names are not
measured, so the forest can't see its labels. Some stated files look hand-written all the same, and many produced
files state nothing, so labels are positive and unlabelled ones with errors: a first forest, its classes weighted
alike, scores the sample; the stated files that score at least their mean and the others that score under ``RELIABLE``
times that mean fit a second one, which decides at ``LINE``.

Three kinds are told beside the forest, each in a column of its own. ``stated``: the labels themselves, taken at their
word, also where the content looks hand-written. ``third_party``: files in a folder of packages, or with
``LIBRARY_SHARE`` of their words in common with a file of a known library; these look hand-written, so no measure
of content could tell them. ``bulk_data``: files that are literals for the most part; they bear no notices that a
forest could learn from. Library files and files meet over keys of minimum hashes in a join of tables, so
neither side is held in one place, and are then compared exactly.

Cases: null and empty sources, settings files and unknown extensions give no row; damaged and misnamed
files are no cases; a name or notice in any case counts; ids must be unique; repeated rows under other ids are
rows of their own; other columns are ignored; without any stated file the forest gives no score, and only the three
other kinds count; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexing import Skim, language_of, skim
from ..plans.rounds import cut, stored
from .near import Signer, rows_of
from .syntax import problem_of

TRAINING_ROWS = 12_000
SEED = 5
TREES, DEPTH, LEAST_IN_NODE = 40, 7, 3
RELIABLE = 0.5
LINE = 0.25  # score from which a file is produced: half the share of produced files, about one half, that state it (Elkan and Noto 2008)
LEAST_WORDS = 10  # distinct words from which a file is compared with libraries
LIBRARY_SHARE = 0.7  # words shared / words in either, from which a file is a library's
FEATURES = ("compression", "token_entropy", "identifier_mean", "identifier_spread", "comment_density", "line_variety", "digit_share", "literal_share", "line_mean", "line_longest", "lines", "short_identifiers", "value_share", "common_form")
_LANGUAGES = {"python", "javascript", "typescript", "java", "c", "cpp", "csharp", "go", "rust"}

# fixed values: how generators, in several languages, and minifiers introduce their files
_NOTICE = re.compile(
    r"^(?:this (?:file|code|source) (?:is|was|has been) (?:automatically |auto-?)?(?:generated|produced|created)\b|(?:this (?:file|code) (?:is|was) )?(?:automatically|auto)[ -]?(?:generated|produced)(?! method| constructor| function)|<auto-?generated|code generated (?:by|from)|(?:(?:source|file|code) )?(?:generated|produced) (?:by|from|with)\b|@generated\b|do not (?:edit|modify|change)(?: this file| by hand| manually|[.!]|$)"
    r"|(?:diese datei (?:ist|wurde) )?automatisch (?:erzeugt|generiert|erstellt)|(?:ce )?fichier (?:produit|généré|genere|créé|cree)|(?:este )?archivo (?:generado|creado)|(?:este )?(?:arquivo|ficheiro) (?:gerado|criado)|(?:questo )?file (?:generato|creato)|(?:dit )?bestand (?:is )?(?:automatisch )?(?:gegenereerd|gemaakt)|automatisch gegenereerd|(?:ten )?plik (?:został )?(?:wygenerowany|utworzony)|(?:этот )?файл (?:создан|сгенерирован)|автоматически (?:создан|сгенерирован)|(?:此|本)?文件(?:由|是).*(?:自动)?生成|自动生成|このファイルは.*(?:自動)?生成|自動生成)",
    re.I,
)
_MINIFIED = re.compile(r"\s*/\*!\s*[\w.@/-]+ v?\d[\w.]*")
_MINIFIED_NAME = re.compile(r"(?:[.-]min|[.]bundle|[.-]bundled|[.]chunk|[.]packed)\.(?:js|mjs|ts|css)$", re.I)
_GENERATED_NAME = re.compile(r"(?:_pb2(?:_grpc)?|\.pb(?:-c)?|_pb|\.generated|_generated|_gen|\.gen|\.g|\.designer|OuterClass|_moc|\.moc|_rc|_ui|\.auto|\.grpc|_grpc|\.g\.i|zz_generated\.\w+|_autogen|\.freezed|_string)\.\w+$", re.I)
_MOC = re.compile(r"^(?:moc_|ui_|qrc_|zz_generated)", re.I)
# fixed values: folders that package managers and projects keep others' packages in, one folder a package
_PACKAGE_DIR = re.compile(r"(?:^|/)(?:third[_-]?party|thirdparty|3rd[_-]?party|3rdparty|vendor|vendored|_vendor|node_modules|bower_components|jspm_packages|site-packages|deps|externals?|extern|ext[_-]?libs?|pods|carthage|godeps|gopath|subprojects|contrib)/[^/]+/.+", re.I)

_IDENT = re.compile(r"[A-Za-z_]\w*")
_LIBRARY_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_NUMBER = re.compile(r"\b\d[\w.]*")
_FORM = re.compile(r"\"\s*")


def head_of(src: str, lang: str, k: Skim) -> tuple[list[str], int]:
    """The lines of the comments before the first code, and where that code begins."""
    at, lines = 0, []
    comments = sorted(k.comments)
    for s, e in comments:
        if k.code[at:s].strip(" \t\r\n﻿"):
            break
        lines += src[s:e].split("\n")
        at = e
    return [re.sub(r"^[\s/*#!\-]+|[\s*/]+$", "", x) for x in lines], at


def states_produced(src: str, filename: str, lang: str, k: Skim) -> tuple[bool, bool, int]:
    """(the head or name states a generator, it states a minifier, where the head ends)."""
    lines, at = head_of(src, lang, k)
    base = filename.replace("\\", "/").rsplit("/", 1)[-1]
    made = any(_NOTICE.match(x) for x in lines) or bool(_GENERATED_NAME.search(base) or _MOC.match(base))
    longest = max(map(len, src.split("\n")), default=0)
    small = bool(_MINIFIED_NAME.search(base)) or (bool(_MINIFIED.match(src)) and longest > 300)
    return made, small, at


def measures(src: str, k: Skim, at: int) -> tuple[list[float], Counter]:
    """The FEATURES of the text behind its head, and its line forms with their counts."""
    body, code = src[at:], k.code[at:]
    raw = body.encode("utf-8", "replace")
    n = max(1, len(body))
    idents = _IDENT.findall(code)
    counts = Counter(idents)
    total = max(1, len(idents))
    entropy = -sum(c / total * math.log2(c / total) for c in counts.values())
    sizes = Counter(map(len, idents)) or Counter([0])
    number = sum(sizes.values())
    letters = sum(x * c for x, c in sizes.items())
    mean = letters / number
    spread = math.sqrt(sum(c * (x - mean) ** 2 for x, c in sizes.items()) / number)
    lines = body.split("\n")
    filled = [x for x in lines if x.strip()]
    forms = Counter(map(str.strip, _NUMBER.sub("9", _IDENT.sub("w", _FORM.sub("S", code))).split("\n")))
    forms.pop("", None)
    n_forms = sum(forms.values())
    seen = len(code) - sum(map(code.count, " \n\t\r")) + sum(len(x) - 1 for x in _FORM.findall(code))
    comments = sum(e - s for s, e in k.comments if s >= at)
    literals = sum(e - s for s, e in k.strings if s >= at)
    values = [
        len(zlib.compress(raw, 1)) / max(40, len(raw)),
        entropy,
        mean,
        spread,
        comments / n,
        len(forms) / max(1, n_forms),
        sum(map(code.count, "0123456789")) / n,
        literals / n,
        sum(map(len, filled)) / max(1, len(filled)),
        math.log1p(max(map(len, lines), default=0)),
        math.log1p(n_forms),
        sum(c for x, c in sizes.items() if x <= 2) / number,
        1 - letters / max(1, seen),
        max(forms.values(), default=0) / max(1, n_forms),
    ]
    return values, forms


def mostly_literals(values: list[float], forms: Counter, size: int) -> bool:
    """Whether the file is bulk data: four fifths of its characters literals and separators, over a thousand
    characters, or thirty lines, few forms among them, four of five with three literals or more."""
    if values[12] >= 0.8 and size >= 1000 and values[6] + values[7] >= 0.4:
        return True
    n = sum(forms.values())
    if n < 30 or values[5] > 0.15:
        return False
    return sum(c for x, c in forms.items() if x.count("9") + x.count("S") >= 3) >= 0.8 * n


def library_keys(library: DataFrame) -> DataFrame:
    """(lib_id, key): the keys of every library file's words; lib_id is the hash of its text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signer = Signer()
        for f in frames:
            yield pd.DataFrame([(i, k) for i, text in zip(f["lib_id"], f["lib_text"]) for k in signer.keys(set(_LIBRARY_WORD.findall(text)))], columns=["lib_id", "key"])

    return _library(library).mapInPandas(run, "lib_id long, key long").distinct()


def _library(library: DataFrame) -> DataFrame:
    return library.select(F.xxhash64("source").alias("lib_id"), F.col("source").alias("lib_text")).filter("lib_text IS NOT NULL").dropDuplicates(["lib_id"])


def library_copies(measured: DataFrame, narrow: DataFrame, library: DataFrame) -> DataFrame:
    """(file_id, nearest): files that share LIBRARY_SHARE of the words of some library file, and the largest share."""
    found = cut(measured.select("file_id", F.explode("keys").alias("key")).join(library_keys(library), "key").select("file_id", "lib_id").distinct())
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(f"({_LIBRARY_WORD.pattern})"), 1))
    files = rows_of(narrow, found.select("file_id").distinct(), "file_id").select("file_id", words(F.col("file_text")).alias("own"))
    both = found.join(files, "file_id").join(_library(library).select("lib_id", words(F.col("lib_text")).alias("theirs")), "lib_id")
    shared = F.size(F.array_intersect("own", "theirs"))
    share = shared / (F.size("own") + F.size("theirs") - shared)
    return both.groupBy("file_id").agg(F.max(share).alias("nearest")).filter(F.col("nearest") >= LIBRARY_SHARE)


def _narrow(files: DataFrame, id_col: str, filename_col: str, source_col: str) -> DataFrame:
    narrow = files.select(F.col(id_col).alias("file_id"), F.col(filename_col).alias("file_name"), F.col(source_col).alias("file_text"))
    return narrow.filter(F.col("file_text").isNotNull() & (F.col("file_text") != ""))


def measure_files(files: DataFrame, id_col: str = "id", filename_col: str = "filename", source_col: str = "source") -> DataFrame:
    """file_id, stated, packaged, bulk_data, damaged, keys and the FEATURES of every code file with text."""
    narrow = _narrow(files, id_col, filename_col, source_col)
    kind = dict(narrow.dtypes)["file_id"]
    columns = ["file_id", "stated", "packaged", "bulk_data", "damaged", "keys", *FEATURES]
    schema = f"file_id {kind}, stated boolean, packaged boolean, bulk_data boolean, damaged boolean, keys array<long>, " + ", ".join(f"{x} double" for x in FEATURES)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signer = Signer()
        for f in frames:
            rows = []
            for i, name, src in zip(f["file_id"], f["file_name"], f["file_text"]):
                lang = language_of(name)
                if lang not in _LANGUAGES:
                    continue
                k = skim(src, lang)
                made, small, at = states_produced(src, name, lang, k)
                values, forms = measures(src, k, at)
                packaged, bulk = bool(_PACKAGE_DIR.search(name.replace("\\", "/"))), mostly_literals(values, forms, len(src) - at)
                # only what could come out as produced has to be whole
                odd = made or small or packaged or bulk or values[5] < 0.35 or values[9] > 6 or values[12] > 0.6
                problem = problem_of(src, lang, None if src[0] == "\ufeff" else k) if odd else None
                # a generated Go file may lack its package clause, which its notice has displaced
                damaged = problem is not None and not (made and problem == "no beginning of the language" and lang == "go")
                words = set(_LIBRARY_WORD.findall(src))
                keys = signer.keys(words) if len(words) >= LEAST_WORDS else []
                rows.append((i, made or small, packaged, bulk, damaged, keys, *values))
            yield pd.DataFrame(rows, columns=columns)

    return narrow.mapInPandas(run, schema)


def _fit(labelled: DataFrame):
    """A forest on features and label, both classes of the same weight."""
    n1, n0 = labelled.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    weighted = labelled.withColumn("weight", F.when(F.col("label") == 1, F.lit(n0 / max(1, n1))).otherwise(F.lit(1.0)))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=LEAST_IN_NODE, seed=SEED, featureSubsetStrategy="onethird", weightCol="weight")
    return forest.fit(weighted)


def produced_files(files: DataFrame, library: DataFrame | None = None, id_col: str = "id", filename_col: str = "filename", source_col: str = "source") -> DataFrame:
    """file_id, stated, third_party, bulk_data, score, produced of every code file with text that is not damaged."""
    measured = stored(measure_files(files, id_col, filename_col, source_col), "measures")
    if library is not None:
        copies = library_copies(measured, _narrow(files, id_col, filename_col, source_col), library).select("file_id", F.lit(True).alias("copied"))
        measured = measured.join(copies, "file_id", "left")
    else:
        measured = measured.withColumn("copied", F.lit(False))
    measured = measured.drop("keys").withColumn("third_party", F.col("packaged") | F.coalesce("copied", F.lit(False)))
    measured = measured.filter(~F.col("damaged"))
    n = measured.count()
    share = min(1.0, TRAINING_ROWS / max(1, n))
    sample = measured if share == 1 else measured.filter(F.pmod(F.xxhash64(F.col("file_id"), F.lit(SEED)), F.lit(1_000_000)) < int(share * 1_000_000))
    local = sample.filter("NOT third_party").orderBy("file_id").select("stated", *FEATURES).toPandas()
    if local["stated"].nunique() == 2:
        spark = files.sparkSession
        vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        p1 = vector_to_array("probability")[1]
        train = vectors.transform(spark.createDataFrame(local.assign(label=local["stated"].astype(float)))).select("features", "label").coalesce(2)
        first = _fit(train).transform(train).select("features", "label", p1.alias("score"))
        mean = first.filter("label = 1").agg(F.avg("score")).first()[0]
        sure = first.filter(((F.col("label") == 1) & (F.col("score") >= mean)) | ((F.col("label") == 0) & (F.col("score") < RELIABLE * mean)))
        measured = _fit(sure.select("features", "label")).transform(vectors.transform(measured)).withColumn("score", p1)
    else:
        measured = measured.withColumn("score", F.lit(0.0))
    produced = F.col("stated") | F.col("third_party") | F.col("bulk_data") | (F.col("score") >= LINE)
    return measured.select("file_id", "stated", "third_party", "bulk_data", "score", produced.alias("produced"))
