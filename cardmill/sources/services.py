"""External services behind small interfaces: notes, embeddings, language model.

Each has an in-memory form for tests and offline use. Calls run on executors in batches; what fails gives null, never
an error, as a missing vector or answer only makes an operator say less.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cardmill import storage

BATCH, SECONDS = 64, {"embed": 120, "answer": 30, "notes": 5, "probe": 4}


class NoteService(Protocol):
    def decks(self) -> list[str]: ...
    def find(self, query: str) -> list[int]: ...
    def notes(self, ids: list[int]) -> list[dict]: ...
    def add(self, note: dict) -> int | None: ...
    def delete(self, ids: list[int]) -> None: ...


class HttpNotes:
    """A note service that takes {action, version, params} as JSON."""

    def __init__(self, url: str):
        self.url = url

    def _call(self, action: str, **params: Any) -> Any:
        body = json.dumps({"action": action, "version": 6, "params": params}).encode()
        with urllib.request.urlopen(urllib.request.Request(self.url, body), timeout=SECONDS["notes"]) as r:  # noqa: S310
            answer = json.load(r)
        if answer.get("error"):
            raise RuntimeError(answer["error"])
        return answer["result"]

    def decks(self) -> list[str]:
        return self._call("deckNames")

    def find(self, query: str) -> list[int]:
        return self._call("findNotes", query=query)

    def notes(self, ids: list[int]) -> list[dict]:
        return self._call("notesInfo", notes=ids)

    def add(self, note: dict) -> int | None:
        return self._call("addNote", note=note | {"options": {"allowDuplicate": False}})

    def add_tags(self, ids: list[int], tags: str) -> None:
        self._call("addTags", notes=ids, tags=tags)

    def remove_tags(self, ids: list[int], tags: str) -> None:
        self._call("removeTags", notes=ids, tags=tags)

    def update(self, note: int, fields: dict[str, str]) -> None:
        self._call("updateNoteFields", note={"id": note, "fields": fields})

    def delete(self, ids: list[int]) -> None:
        self._call("deleteNotes", notes=ids)


class MemoryNotes:
    """Notes held in a dictionary: {id: note}."""

    def __init__(self, notes: dict[int, dict] | None = None, decks: list[str] | None = None):
        self.held, self._decks = dict(notes or {}), decks

    def decks(self) -> list[str]:
        return self._decks if self._decks is not None else sorted({n["deckName"] for n in self.held.values()})

    def find(self, query: str) -> list[int]:
        deck, tag = query.partition('deck:"')[2].partition('"')[0], query.partition("tag:")[2].partition(" ")[0]
        return [i for i, n in self.held.items() if (not deck or n.get("deckName") == deck) and (not tag or tag in n.get("tags", []))]

    def notes(self, ids: list[int]) -> list[dict]:
        return [self.held[i] for i in ids if i in self.held]

    def add(self, note: dict) -> int | None:
        new = max(self.held, default=0) + 1
        self.held[new] = {"noteId": new, **note}
        return new

    def add_tags(self, ids: list[int], tags: str) -> None:
        for i in ids:
            held = self.held[i].setdefault("tags", [])
            held.extend(t for t in tags.split() if t not in held)

    def remove_tags(self, ids: list[int], tags: str) -> None:
        for i in ids:
            self.held[i]["tags"] = [t for t in self.held[i].get("tags", []) if t not in tags.split()]

    def update(self, note: int, fields: dict[str, str]) -> None:
        self.held[note].setdefault("fields", {}).update(fields)

    def delete(self, ids: list[int]) -> None:
        for i in ids:
            self.held.pop(i, None)


def expand_deck(decks: list[str], deck: str) -> list[str]:
    """The deck with its subdecks; the name itself if there is none."""
    return [d for d in decks if d == deck or d.startswith(deck + "::")] or [deck]


NOTE = "note_id bigint, deck_name string, note_type string, tags array<string>, fields array<struct<name:string,value:string>>"


class NoteSource(DataSource):
    """``spark.read.format("cardmill_notes")``: one partition a deck; option ``days`` is pushed to the service as ``added:``."""

    @classmethod
    def name(cls) -> str:
        return "cardmill_notes"

    def schema(self) -> str:
        return NOTE

    def reader(self, schema: Any) -> DataSourceReader:
        return _NoteReader(dict(self.options))


class _Deck(InputPartition):
    def __init__(self, deck: str):
        self.deck = deck


class _NoteReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def _service(self) -> NoteService:
        held = self.options.get("notes")
        return MemoryNotes({int(k): v for k, v in json.loads(held).items()}) if held else HttpNotes(self.options["url"])

    def partitions(self) -> list[InputPartition]:
        deck, decks = self.options.get("deck"), self._service().decks()
        return [_Deck(d) for d in (expand_deck(decks, deck) if deck else decks)]

    def read(self, partition: _Deck) -> Iterator[tuple]:
        service, days = self._service(), self.options.get("days")
        ids = service.find(f'deck:"{partition.deck}"' + (f" added:{days}" if days else ""))
        for at in range(0, len(ids), 500):
            for n in service.notes(ids[at : at + 500]):
                fields = [{"name": k, "value": v["value"] if isinstance(v, dict) else v} for k, v in n.get("fields", {}).items()]
                yield n["noteId"], partition.deck, n.get("modelName"), n.get("tags", []), fields


def note_cards(notes: DataFrame, front: str, back: str) -> DataFrame:
    """Notes with ``front`` and ``back``: the named field, else the first one (front) or the first other one (back); blank fronts dropped."""
    named = lambda want: F.get(F.filter("fields", lambda f: f["name"] == want), F.lit(0))
    chosen = notes.withColumn("f", F.coalesce(named(front), F.get("fields", F.lit(0))))
    other = F.get(F.filter("fields", lambda f: f["name"] != F.col("f.name")), F.lit(0))
    out = chosen.withColumns({"front": F.col("f.value"), "back": F.coalesce(named(back)["value"], other["value"], F.lit(""))})
    return out.drop("f", "fields").filter(F.trim("front") != "")


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]] | None: ...


class HttpEmbedder:
    def __init__(self, url: str, model: str):
        self.url, self.model = url, model

    def embed(self, texts: list[str], seconds: float = SECONDS["embed"]) -> list[list[float]] | None:
        """Vectors of a batch; None on any failure or if their number differs."""
        try:
            body = json.dumps({"model": self.model, "input": texts}).encode()
            with urllib.request.urlopen(urllib.request.Request(f"{self.url}/api/embed", body, {"Content-Type": "application/json"}), timeout=seconds) as r:  # noqa: S310
                vectors = json.load(r).get("embeddings")
            return vectors if vectors and len(vectors) == len(texts) else None
        except Exception:
            return None

    def available(self) -> bool:
        """Whether the service answers at all, within a few seconds."""
        return self.embed(["ping"], SECONDS["probe"]) is not None


def embeddings_used(df: DataFrame, embedder: Any | None) -> DataFrame:
    """Adds ``embeddings_used``: whether vectors had a part in the result, asked for once on the driver."""
    probe = getattr(embedder, "available", lambda: embedder is not None)
    return df.withColumn("embeddings_used", F.lit(bool(probe())))


def embed_missing(records: DataFrame, cached: DataFrame, embedder: Embedder, text: str = "text", key: str = "fingerprint") -> DataFrame:
    """``<key>, vector`` of the records without a cached vector, in batches; a failed batch gives none of its rows."""
    misses = records.join(cached.select(key), key, "left_anti").select(key, text).dropDuplicates([key])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), BATCH):
                part = f.iloc[at : at + BATCH]
                vectors = embedder.embed(part[text].tolist())
                if vectors:
                    yield pd.DataFrame({key: part[key].to_numpy(), "vector": [list(map(float, v)) for v in vectors]})

    return misses.mapInPandas(run, f"{key} string, vector array<double>")


def embedded(records: DataFrame, cache: DataFrame, embedder: Embedder, model: str, at: str, text: str = "text", key: str = "fingerprint", record: str = "record_id") -> tuple[DataFrame, DataFrame]:
    """(``record_id, vector`` of all records that have one, rows to add to the cache): cached vectors, and new ones for the rest."""
    held = cache.filter((F.col("model") == model) & (F.size("vector") > 0)).groupBy(key).agg(F.max_by("vector", F.struct("created_at", "vector")).alias("vector"))
    new = storage.Scratch(records.sparkSession, "embedded").cut(embed_missing(records, held, embedder, text, key), "new")  # written at once: a later read must not ask again
    rows = new.filter(F.size("vector") > 0).select(key, F.lit(model).alias("model"), F.size("vector").alias("dim"), "vector", F.lit(at).alias("created_at"))
    return records.join(held.unionByName(new), key).select(record, "vector"), rows


class LanguageModel(Protocol):
    def answer(self, prompt: str) -> str | None: ...


class HttpModel:
    """A language model behind ``/api/generate``, without randomness."""

    def __init__(self, url: str, model: str):
        self.url, self.model = url, model

    def answer(self, prompt: str) -> str | None:
        """The text of the answer; None on any failure."""
        try:
            body = json.dumps({"model": self.model, "prompt": prompt, "stream": False, "options": {"temperature": 0}}).encode()
            with urllib.request.urlopen(urllib.request.Request(f"{self.url}/api/generate", body, {"Content-Type": "application/json"}), timeout=SECONDS["answer"]) as r:  # noqa: S310
                out = json.load(r).get("response")
            return out if isinstance(out, str) else None
        except Exception:
            return None


def model_facets(cards: DataFrame, required: list[str], categories: dict[str, tuple[str, ...]], model: LanguageModel, key: str = "record_id") -> DataFrame:
    """Adds ``model_scope``: facets that a language model gives for the required categories a card lacks, valid values only.

    Only cards that lack one are asked about; no answer, or one that isn't JSON, gives no facets.
    """
    asked = {c: list(categories[c]) for c in required if categories.get(c)}
    lack = F.filter(F.array(*[F.lit(c) for c in asked]).cast("array<string>"), lambda c: ~F.array_contains(F.map_keys("scope"), c))
    open_cards = cards.withColumn("_lack", lack).filter(F.size("_lack") > 0).select(key, "front", "back", "_lack")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            answers = []
            for r in f.itertuples(index=False):
                options = json.dumps({c: asked[c] for c in r[3]}, ensure_ascii=False)
                answers.append(model.answer(f"Choose one value for each category from its list, or leave the category out. Answer with a JSON object only.\nQuestion: {r[1]}\nAnswer: {r[2]}\nCategories: {options}"))
            yield pd.DataFrame({key: f[key], "_answer": answers, "_asked": f["_lack"]})

    field = cards.schema[key].dataType.simpleString()
    said = storage.Scratch(cards.sparkSession, "answers").cut(open_cards.mapInPandas(run, f"{key} {field}, _answer string, _asked array<string>"), "answers")
    found = F.map_filter(facets_from_answer(F.col("_answer"), {c: tuple(v) for c, v in asked.items()}), lambda c, v: F.array_contains("_asked", c))
    none = F.create_map().cast("map<string,string>")
    return cards.join(said.select(key, found.alias("model_scope")), key, "left").withColumn("model_scope", F.coalesce("model_scope", none))


def facets_from_answer(answer: Column, categories: dict[str, tuple[str, ...]]) -> Column:
    """Facet map from a model's answer: the first { to the last } as JSON, with valid values of the asked categories only."""
    parsed = F.from_json(F.regexp_extract(answer, r"(?s)\{.*\}", 0), "map<string,string>")

    def valid(c: Column, v: Column) -> Column:
        out = F.lit(False)
        for name, values in categories.items():
            out = out | ((c == name) & v.isin(list(values)))
        return out

    return F.coalesce(F.map_filter(parsed, valid), F.create_map().cast("map<string,string>"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NoteSource)
