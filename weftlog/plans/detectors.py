"""Detectors: windows to role scores, trained on benign runs. Each is a strategy and what it has learned."""

from __future__ import annotations

import abc
import json
from typing import Any, ClassVar

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlog.config import get
from weftlog.functions.encoding import SCALED, FeatureSpec, entity_features, event_features
from weftlog.functions.tokens import dns_token, template_path
from weftlog.operators import alerts, boosting, graphs, links, losses, memory, messages, models, skipgram, sentences, stats, training, windows
from weftlog.schema import API, DNS, RPC, SCORES, conform
from weftlog.scratch import fresh, read_text, write_text, written
from weftlog.sources.runs import load

_REGISTRY: dict[str, type[Detector]] = {}


def register(cls):
    _REGISTRY[cls.name] = cls
    return cls


def get_detector(name: str) -> type[Detector]:
    if name not in _REGISTRY:
        raise KeyError(f"unknown detector {name!r}; have {sorted(_REGISTRY)}")
    return _REGISTRY[name]


def objective(name: str) -> str:
    """Known training objectives; one is declared but not built."""
    if name == "masked_recon":
        raise NotImplementedError("masked reconstruction is declared only")
    if name not in ("flash_cls", "ppt_cls"):
        raise KeyError(f"unknown objective {name!r}")
    return name


def window_spec(config: dict) -> windows.WindowSpec:
    width = float(get(config, "windows.width_s"))
    return windows.WindowSpec.seconds(width, float(get(config, "windows.stride_s")), float(get(config, "windows.min_tail_s", width)))


class Detector(abc.ABC):
    """What all detectors share: vocabulary, benign scores, thresholds, bundle."""

    name: ClassVar[str]

    def __init__(self, config: dict, vocabulary: DataFrame, splits: dict[str, list[str]]):
        self.config, self.vocabulary, self.splits = config, vocabulary, splits
        self.models: dict[str, Any] = {}
        self.tables: dict[str, DataFrame] = {}

    @classmethod
    def train(cls, config: dict, events: DataFrame, entities: DataFrame, splits: dict[str, list[str]]) -> Detector:
        """Fit everything on the train runs, norms and thresholds on the val runs; they hold benign runs only."""
        objective(get(config, "model.objective"))
        part = lambda df, name: df.where(F.col("run_id").isin(splits[name]))
        out = cls(config, written(stats.label_vocabulary(part(entities, "train")), "vocabulary"), splits)
        out._fit(part(events, "train"), part(entities, "train"), part(events, "val"), part(entities, "val"))
        out.tables["benign"] = written(out._raw(part(events, "val"), part(entities, "val")).select("node_type", "score_raw"), "benign")
        out.tables["thresholds"] = written(alerts.quantile_thresholds(out.tables["benign"], float(get(config, "scoring.threshold_q"))), "thresholds")
        return out

    @abc.abstractmethod
    def _fit(self, events: DataFrame, entities: DataFrame, val_events: DataFrame, val_entities: DataFrame) -> None: ...

    @abc.abstractmethod
    def _raw(self, events: DataFrame, entities: DataFrame, config: dict | None = None, strip_verdict: bool | None = None, only: DataFrame | None = None) -> DataFrame:
        """Scores without score_norm. ``only`` is (run_id, entity_id); windows without any of them may be left out."""

    def score(self, events: DataFrame, entities: DataFrame, config: dict | None = None, strip_verdict: bool | None = None, only: DataFrame | None = None) -> DataFrame:
        """Score records of every node of every window."""
        return conform(alerts.normalised(self._raw(events, entities, config, strip_verdict, only), self.tables["benign"]), SCORES)

    def ablations(self) -> dict[str, list[tuple[str, Any]]]:
        """Settings to score with again, without training again."""
        return {}

    def save(self, path: str) -> None:
        """The bundle: models and tables in Spark's formats, and what is small as JSON."""
        for name, model in self.models.items():
            if model is not None:
                model.write().overwrite().save(f"{path}/models/{name}")
        for name, table in (self.tables | {"vocabulary": self.vocabulary}).items():
            table.coalesce(1).write.mode("overwrite").parquet(f"{path}/tables/{name}")
        manifest = {"detector": self.name, "splits": self.splits, "config": self.config, "models": {k: type(v).__name__ for k, v in self.models.items()}, "tables": sorted(self.tables), "extra": self._extra()}
        write_text(self.vocabulary.sparkSession, f"{path}/detector.json", json.dumps(manifest, indent=2))

    def _extra(self) -> dict:
        return {}

    def _restore(self, extra: dict) -> None:
        return None

    @classmethod
    def load(cls, spark: SparkSession, path: str, config: dict) -> Detector:
        manifest = json.loads(read_text(spark, f"{path}/detector.json"))
        out = cls(config, spark.read.parquet(f"{path}/tables/vocabulary"), manifest["splits"])
        kinds = {k.__name__: k for k in (LogisticRegressionModel, PCAModel)}
        out.models = {name: kinds[kind].load(f"{path}/models/{name}") if kind in kinds else None for name, kind in manifest["models"].items()}
        out.tables = {name: spark.read.parquet(f"{path}/tables/{name}") for name in manifest["tables"]}
        out._restore(manifest["extra"])
        return out


def load_detector(spark: SparkSession, config: dict) -> Detector:
    """The bundle in the configured folder; it must be the configured detector's."""
    path = get(config, "artifacts_dir")
    tag = json.loads(read_text(spark, f"{path}/detector.json")).get("detector", "flash")
    if tag != get(config, "detector"):
        raise SystemExit(f"{path} holds a {tag!r} detector, but {get(config, 'detector')!r} is configured")
    return get_detector(tag).load(spark, path, config)


@register
class WindowDetector(Detector):
    """Sentences of entities in sliding windows, encoded, propagated over the window's graph, and classified."""

    name = "flash"
    ALL = ("x", "x1", "x2")
    #: What each booster sees.
    COLUMNS: ClassVar[dict[str, tuple[str, ...]]] = {"xgb": ALL, "w2v": ("x",)}

    def __init__(self, config: dict, vocabulary: DataFrame, splits: dict[str, list[str]]):
        super().__init__(config, vocabulary, splits)
        self.boosters: dict[str, boosting.Booster | None] = {}

    def _placed(self, events: DataFrame) -> DataFrame:
        return windows.assign_windows(events, window_spec(self.config))

    def _sentences(self, placed: DataFrame, config: dict, strip: bool | None) -> DataFrame:
        strip = bool(get(config, "sentences.strip_verdict_tokens")) if strip is None else strip
        return sentences.sentences(placed, int(get(config, "sentences.max_repeats_per_signature")), int(get(config, "sentences.max_tokens")), strip)

    def _nodes(self, events: DataFrame, entities: DataFrame, config: dict, strip: bool | None, only: DataFrame | None = None) -> DataFrame:
        placed = written(self._placed(events), "placed")
        if only is not None:
            ends = placed.select("run_id", "w_idx", F.explode(F.array("src_id", "dst_id")).alias("entity_id"))
            placed = placed.join(ends.join(only, ["run_id", "entity_id"], "left_semi").select("run_id", "w_idx").distinct(), ["run_id", "w_idx"], "left_semi")
        size, workloads = int(get(config, "w2v.dim")), bool(get(config, "graph.include_workload_nodes"))
        x = models.encoded(written(self._sentences(placed, config, strip), "sentences"), self.tables["vectors"], size)
        nodes = graphs.incident_nodes(placed, entities, workloads).join(x, ["run_id", "w_idx", "entity_id"], "left").withColumn("x", F.coalesce("x", F.array_repeat(F.lit(0.0), size)))
        nodes = written(nodes, "nodes")
        edges = written(graphs.window_edges(placed, entities, bool(get(config, "graph.reverse_edges")), workloads), "edges")
        full = graphs.propagated(edges, nodes, ["run_id", "w_idx"], int(get(config, "model.hops")), width=size)
        return written(stats.with_label_index(full, self.vocabulary), "features")

    def _fit(self, events: DataFrame, entities: DataFrame, val_events: DataFrame, val_entities: DataFrame) -> None:
        c, seed = self.config, int(get(self.config, "seed"))
        said = written(self._sentences(written(self._placed(events), "placed"), c, None), "sentences")
        size, window, epochs, least = (int(get(c, f"w2v.{x}")) for x in ("dim", "window", "epochs", "min_count"))
        drawn = int(get(c, "w2v.negatives"))
        vectors = skipgram.train(said, size, window, epochs, drawn, least, seed) if drawn else models.token_vectors(said, size, window, epochs, least, seed)
        self.tables["vectors"] = written(vectors, "vectors")
        nodes, val_nodes = self._nodes(events, entities, c, None), self._nodes(val_events, val_entities, c, None)
        self.models = {"gnn": models.role_regression(nodes, list(self.ALL), int(get(c, "train.max_iter")), float(get(c, "train.reg")))}
        for source, columns in self.COLUMNS.items():
            x = [F.concat(*columns).alias("x"), "y"]
            rows = written(nodes.select(*x, F.lit(False).alias("val")).unionByName(val_nodes.select(*x, F.lit(True).alias("val"))), "boosted")
            own = lambda name: get(c, f"train.xgb.{name}")
            self.boosters[source] = boosting.fit(rows, self.vocabulary.count(), int(own("n_estimators")), int(own("max_depth")), float(own("learning_rate")), int(own("early_stopping_rounds")))

    def _raw(self, events, entities, config=None, strip_verdict=None, only=None):
        config = config or self.config
        nodes, source = self._nodes(events, entities, config, strip_verdict, only), get(config, "scoring.source")
        booster = self.boosters.get(source)
        if booster is None:  # the regression, also where a booster had fewer than two classes
            return models.node_scores(models.probabilities(nodes, self.models["gnn"], list(self.ALL)), self.vocabulary)
        return models.node_scores(boosting.with_probabilities(nodes, booster, list(self.COLUMNS[source])), self.vocabulary)

    def _extra(self) -> dict:
        return {"boosters": {k: None if v is None else v.as_dict() for k, v in self.boosters.items()}}

    def _restore(self, extra: dict) -> None:
        self.boosters = {k: None if v is None else boosting.Booster.of(v) for k, v in extra["boosters"].items()}

    def ablations(self):
        return {source: [("scoring.source", source)] for source in ("w2v", "gnn", "xgb")}


@register
class MemoryDetector(Detector):
    """Entities and events of the last windows as a graph of typed edges, in layers of typed messages.

    An encoder is pretrained by predicting links that were kept from the messages, relation by relation, and tuned to tell the roles of
    the newest copies.  Copies are built once by their window: a copy hears earlier ones, never later ones, so each is the newest of its own
    memory; what it hears of an earlier copy may reach back that copy's own memory.
    """

    name = "ppt"

    def _graph(self, events: DataFrame, entities: DataFrame, config: dict, strip: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(nodes with raw vectors, typed edges, windows)."""
        spec, width = window_spec(config), int(get(config, "model.width"))
        placed = written(windows.assign_windows(events, spec), "placed")
        capped = written(memory.event_nodes(memory.cap_events(placed, int(get(config, "graph.max_events_per_window"))), spec.width), "event-nodes")
        incident = written(memory.incidence(capped, entities, bool(get(config, "graph.include_workload_nodes"))), "incident")
        copies = written(memory.entity_copies(incident), "copies")
        raw = capped.select("run_id", "pos", F.lit("event").alias("kind"), F.col("event_id").alias("id"), array_to_vector(event_features(self.spec, F.col("order"), F.col("rel_time"), strip)).alias("raw"))
        raw = written(raw, "event-features")
        if self.models.get("events") is None:
            self.models["events"] = PCA(k=min(width, self.spec.event_width), inputCol="raw", outputCol="low").fit(raw)
        padded = lambda x: F.slice(F.concat(x, F.array_repeat(F.lit(0.0), width)), 1, width)
        said = self.models["events"].transform(raw).select(*messages.NODE, padded(vector_to_array("low")).alias("x"))
        known = copies.select("run_id", "pos", F.lit("entity").alias("kind"), F.col("entity_id").alias("id"), padded(entity_features(self.spec, F.lit(0))).alias("x"))
        edges = memory.typed_edges(capped, incident, copies, int(get(config, "graph.flow_memory")), int(get(config, "windows.memory")))
        return written(said.unionByName(known), "nodes"), written(edges, "edges"), written(windows.window_table(placed).select("run_id", "pos", "w_idx"), "windows")

    def _encoded(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        out, self.scales = messages.encoded(nodes, edges, int(get(self.config, "model.width")), int(get(self.config, "model.layers")), self.scales)
        return written(out, "encoded")

    def _copies(self, encoded: DataFrame, places: DataFrame, entities: DataFrame) -> DataFrame:
        """Encoded entity copies with window number, label and class."""
        meta = entities.select("run_id", "entity_id", "entity_type", "canonical_service", "namespace")
        rows = encoded.where("kind = 'entity'").select("run_id", "pos", F.col("id").alias("entity_id"), "x").join(places, ["run_id", "pos"]).join(meta, ["run_id", "entity_id"])
        return stats.with_label_index(rows, self.vocabulary)

    def _fit_spec(self, events: DataFrame) -> FeatureSpec:
        c, sizes = self.config, {k: int(get(self.config, f"features.{k}")) for k in ("path_vocab", "dns_vocab", "api_resource_vocab", "time_enc_dim")}
        seen = F.struct("run_id", "ts_us", "ord")
        values = lambda kind, value: events.where(F.col("event_type") == kind).select(value.alias("v"), seen.alias("seen"))
        top = lambda df, size: ["<oov>", *[r.v for r in stats.top_vocabulary(df, "v", "seen", size).orderBy("idx").collect()]]  # noqa: E731  (size rows at most)
        token = dns_token(F.col("dns_query"))
        names = values(DNS, F.when(token.startswith("dst:ext:"), F.substr(token, F.lit(9))))
        row = stats.log_scalers(events.where(F.col("event_type") == RPC), SCALED).first()
        return FeatureSpec(
            top(values(RPC, template_path(F.col("path"), F.col("protocol"))), sizes["path_vocab"]), top(names, sizes["dns_vocab"]), top(values(API, F.lower(F.coalesce("k8s_resource", F.lit("na")))), sizes["api_resource_vocab"]),
            {f: (row[f"{f}_mean"], row[f"{f}_dev"]) for f in SCALED}, sizes["time_enc_dim"], sizes["path_vocab"], sizes["dns_vocab"], sizes["api_resource_vocab"],
        )

    def _fit(self, events: DataFrame, entities: DataFrame, val_events: DataFrame, val_entities: DataFrame) -> None:
        c, own = self.config, lambda path: get(self.config, f"train.{path}")
        self.spec, self.scales = self._fit_spec(events), None
        parts = [(self._graph(e, n, c, False), n, val) for e, n, val in ((events, entities, False), (val_events, val_entities, True))]
        width, hidden, seed = int(get(c, "model.width")), int(get(c, "model.hidden")), int(get(c, "seed"))
        pretrained = self._pretrained(parts, width, hidden, seed) if own("pretrain.enabled") else None
        self.scales = None  # the tuned encoder hears all edges, and its transforms are fitted on them
        copies = None
        for (nodes, edges, places), ents, val in parts:
            rows = self._copies(self._encoded(nodes, edges), places, ents).select("x", "y", F.lit(val).alias("val"))
            copies = rows if copies is None else copies.unionByName(rows)
        self.params, self.losses = training.finetune(
            copies, width, hidden, self.vocabulary.count(), int(own("finetune.max_epochs")), pretrained, float(own("finetune.lr")), float(own("scratch_lr")), float(own("finetune.weight_decay")),
            int(own("finetune.patience")), seed, fresh(events.sparkSession, "finetune"),
        )

    def _pretrained(self, parts: list, width: int, hidden: int, seed: int):
        """The encoder that predicts held-out links; the bundle keeps how well it does by relation."""
        own = lambda name: get(self.config, f"train.pretrain.{name}")
        pairs = None
        for (nodes, edges, _), _, val in parts:
            marked = written(links.supervised(edges, float(own("holdout_frac")), seed), "supervised")
            positives = written(links.smallest(marked.where("held").drop("held"), "relation", links.link_draw(seed + 1), int(own("max_pos_per_type")), "run_id", "pos", "later", "src", "dst"), "positives")
            negatives = links.relation_negatives(positives, edges, max(1, round(float(own("neg_ratio")))), seed)
            both = positives.select(*links.GRAPH, "src", "dst", F.lit(True).alias("positive")).unionByName(negatives.withColumn("positive", F.lit(False)))
            rows = self._with_vectors(both, self._encoded(nodes, marked.where(~F.col("held")).drop("held"))).withColumn("val", F.lit(val))
            pairs = rows if pairs is None else pairs.unionByName(rows)
        pairs = written(pairs, "link-pairs")
        if pairs.where("positive AND NOT val").isEmpty():
            return None
        params, self.link_losses = training.pretrain(pairs, width, hidden, int(own("epochs")), float(own("lr")), int(own("patience")), seed, fresh(pairs.sparkSession, "pretrain"))
        scored = written(training.with_logits(pairs, params), "link-scores")
        areas = stats.auc(scored.where("val"), "logit", F.col("positive"), "relation")
        self.tables["links"] = written(losses.relation_losses(scored.where("val"), "logit", "positive").join(areas.select("relation", "auc"), "relation", "left"), "links")
        return params

    @staticmethod
    def _with_vectors(pairs: DataFrame, encoded: DataFrame) -> DataFrame:
        """Pairs with both ends' vectors, whatever their kinds."""
        kind = lambda i: messages.of_relation({r: ends[i] for r, ends in messages.ENDS.items()})
        end = lambda name, at: encoded.select("run_id", F.col("pos").alias(at), F.col("kind").alias(f"{name}_kind"), F.col("id").alias(name), F.col("x").alias(f"x_{name}"))
        rows = pairs.withColumns({"src_kind": kind(0), "dst_kind": kind(1)})
        rows = rows.join(end("src", "pos"), ["run_id", "pos", "src_kind", "src"]).join(end("dst", "later"), ["run_id", "later", "dst_kind", "dst"])
        return rows.select("relation", "x_src", "x_dst", "positive")

    def _raw(self, events, entities, config=None, strip_verdict=None, only=None):
        nodes, edges, places = self._graph(events, entities, config or self.config, bool(strip_verdict))
        rows = self._copies(self._encoded(nodes, edges), places, entities)
        if only is not None:  # after the graph is built, so that memory is whole
            rows = rows.join(only, ["run_id", "entity_id"], "left_semi")
        return models.node_scores(training.with_probabilities(rows, self.params), self.vocabulary)

    def _extra(self) -> dict:
        spec = {k: getattr(self.spec, k) for k in ("paths", "names", "resources", "scalers", "time_width", "path_width", "name_width", "resource_width")}
        return {"spec": spec, "scales": self.scales, "params": json.loads(training.as_json(self.params))}

    def _restore(self, extra: dict) -> None:
        spec = extra["spec"]
        self.spec = FeatureSpec(**(spec | {"scalers": {k: tuple(v) for k, v in spec["scalers"].items()}}))
        self.scales, self.params = extra["scales"], training.from_json(json.dumps(extra["params"]))


def run_tables(spark: SparkSession, config: dict, runs: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    return load(spark, get(config, "data.parquet_dir"), runs)
