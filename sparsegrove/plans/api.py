"""Training and prediction from files or tables, one step after the other.

    run = Training(spark, settings).samples(traits).alignment(aln, groups)
    models = run.fit()
    tables = run.scores(models)
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import shared_hash
from ..operators import balance, encode, fit, groups, score, screen, tree, view
from ..operators.grid import Settings
from ..operators.solver import Options
from ..session import stored
from ..sources import text
from .views import TOGETHER


@dataclass
class Training:
    """One hypothesis. Every step returns the run itself or a DataFrame. seconds: the wall-clock time of the phases so far; rows: those of the
    tables that each phase wrote, counted while they were written."""

    spark: SparkSession
    settings: Settings = field(default_factory=Settings)
    people: DataFrame | None = None
    sequences: DataFrame | None = None
    numbers: DataFrame | None = None
    lines: DataFrame | None = None
    folds: DataFrame | None = None
    penalties: DataFrame | None = None
    seconds: dict[str, float] = field(default_factory=dict)
    rows: list[tuple[str, str, int]] = field(default_factory=list)

    def samples(self, traits: DataFrame) -> Training:
        """seq_id, trait; zeros are left out. Balances the classes as the settings say."""
        if self.people is not None:
            raise ValueError("the hypothesis is given already: by classes or by a clade of a tree, not both")
        kind = balance.KINDS.get(self.settings.class_balance)
        if kind is None:
            raise ValueError(f"class_balance is one of {sorted(balance.KINDS)}")
        own = traits.where("trait <> 0").select(F.col("seq_id"), F.col("trait").cast("double").alias("trait"))
        if kind == "up":
            self.people = balance.upsample(own, self.settings.seed)
        elif kind == "down":
            self.people = balance.downsample(own, self.settings.seed).withColumn("base_seq_id", F.col("seq_id"))
        elif kind.startswith("phylo"):
            raise ValueError("phylogenetic balancing takes a tree: use clade()")
        else:
            self.people = own.withColumn("base_seq_id", F.col("seq_id"))
        return self

    def clade(self, nodes: DataFrame, name: str) -> Training:
        """The clade of a tree as hypothesis, with all other leaves or, for phylo balancing, near ones."""
        if self.people is not None:
            raise ValueError("the hypothesis is given already: by classes or by a clade of a tree, not both")
        if self.settings.kfold > 1:
            raise ValueError("folds need classes, not a clade")
        kind = balance.KINDS.get(self.settings.class_balance, "none")
        if kind.startswith("phylo"):
            self.people = tree.near_outgroup(nodes, name, {"phylo_1": 1, "phylo_2": 2}.get(kind, 3)).withColumn("base_seq_id", F.col("seq_id"))
            return self
        leaves = nodes.where("is_leaf").select(F.col("name").alias("leaf"))
        return self.samples(tree.clade_hypothesis(tree.clade_members(nodes), leaves, name))

    def alignment(self, sequences: DataFrame, lines: DataFrame | None = None) -> Training:
        """gene, seq_id, seq, and the groups (group_ord, gene_ord, gene); each gene is a group by default. Clones take the sequence of
        the sample they come from."""
        if self.people is None:
            raise ValueError("samples come first")
        names = self.people.select("seq_id", "base_seq_id")
        self.sequences = sequences.withColumnRenamed("seq_id", "base_seq_id").join(names, "base_seq_id").select("gene", "seq_id", "seq")
        self.lines = lines
        return self

    def numeric(self, numbers: DataFrame, lines: DataFrame | None = None) -> Training:
        """gene, seq_id, vals in place of an alignment: each number that differs between samples is a feature. Samples without a row have
        zeros, clones take the row of the sample they come from."""
        if self.people is None:
            raise ValueError("samples come first")
        names = self.people.select("seq_id", "base_seq_id")
        self.numbers = numbers.withColumnRenamed("seq_id", "base_seq_id").join(names, "base_seq_id").select("gene", "seq_id", "vals")
        self.lines = lines
        return self

    def given(self, folds: DataFrame | None = None, group_weights: DataFrame | None = None) -> Training:
        """Folds (seq_id, fold from 1 on) and penalty weights of groups (group_ord, weight, or group, weight with genes as groups' names)."""
        self.folds, self.penalties = folds or self.folds, group_weights or self.penalties
        return self

    def files(self, lambda_list: str | None = None, solver_options: str | None = None, group_weights: str | None = None, folds: str | None = None) -> Training:
        """Penalty pairs, solver options, group weights and folds from files. Folds are in the order of the samples' ids."""
        if lambda_list is not None:
            self.settings = replace(self.settings, pairs=tuple(text.read_grid(self.spark, lambda_list)))
        if solver_options is not None:
            self.settings = replace(self.settings, solver_options=text.read_options(self.spark, solver_options))
        if group_weights is not None:
            self.penalties = text.read_group_weights(self.spark, group_weights)
        if folds is not None:
            if self.people is None:
                raise ValueError("samples come first")
            order = self.people.select("seq_id", "trait", F.expr("row_number() OVER (ORDER BY seq_id) - 1").cast("long").alias("ord"))
            self.folds = text.read_folds(self.spark, folds, order).select("seq_id", "fold")
        return self

    def varying(self) -> DataFrame:
        """gene, pos of the numeric columns that differ between samples; a sample without a row has a zero there."""
        people = self.people.count()
        ranges = encode.numeric_cells(self.numbers).groupBy("gene", "pos").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("n"))
        return ranges.where((F.col("lo") < F.col("hi")) | ((F.col("n") < people) & (F.col("lo") != 0))).select("gene", "pos")

    def salts(self) -> int:
        """Groups that a gene's sequences are dealt to; a gene has at most one of each sample."""
        return max(1, -(-self.people.count() // TOGETHER))

    def encoded(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The design, its features, which are a table, as several steps read them, and the membership of groups with weights."""
        s = self.settings
        if self.numbers is not None:
            found = stored(encode.numeric_features(self.varying()), "features")
            x = encode.numeric_values(self.numbers, found, "feature_id").select("feature_id", "seq_id", "value")
        else:
            cells = encode.explode_cells(self.sequences, s.data_type)
            options = encode.EncodeOptions(s.data_type, s.bit_count, s.drop_singletons)
            found = stored(encode.number_features(encode.kept_bits(encode.allele_counts(cells), options)), "features")
            x = encode.one_hot(self.sequences, found, s.data_type, self.salts())
        if self.lines is None:
            lines = found.select("gene").distinct().select(F.xxhash64("gene").alias("group_ord"), F.lit(0).alias("gene_ord"), "gene")
        else:
            lines = self.lines
        members = groups.field(found, lines)
        index = groups.group_index(members)
        if self.penalties is not None:
            index = groups.group_weights(index, self.penalties, lines.select("group_ord", F.col("gene").alias("group")).distinct())
        weights = index.select("group_ord", "weight")
        return x, found, members.join(weights, "group_ord").select("feature_id", "group_ord", "weight")

    def fit(self) -> DataFrame:
        """The models of the grid that the skip rule keeps, with their gene, pos, allele and the flag below_min_groups, as a table. With
        subsets the genes are screened first, and the grid is fitted on those that are kept."""
        s = self.settings
        began = time.perf_counter()
        x, found, members = (self.counted("preprocessing", n, t) for n, t in zip(("design", "features", "members"), self.encoded(), strict=True))
        self.seconds["preprocessing"] = time.perf_counter() - began
        began = time.perf_counter()
        pairs = [(float(a), float(b)) for a, b in s.grid()]
        if members.select("group_ord").distinct().count() == 1:  # one group: no group penalty
            pairs = [(a, 0.0) for a in dict.fromkeys(a for a, _ in pairs)]
        options = Options.parse(s.solver_options)
        if balance.KINDS[s.class_balance] == "weighted":
            options = replace(options, balanced=True)
        folds = self.folds
        if folds is None and s.kfold > 1:
            fold = F.pmod(F.floor(shared_hash(F.xxhash64("seq_id")) / 65536), F.lit(s.kfold)) + 1
            folds = self.people.select("seq_id", fold.cast("int").alias("fold"))
        people = self.people.select("seq_id", "trait")
        subsets = screen.parts_needed(x.count(), found.count(), s.memory) if s.subsets == 0 else s.subsets
        if subsets is not None and subsets > 1:
            held, length = (self.sequences, F.octet_length("seq")) if self.numbers is None else (self.numbers, 8 * F.size("vals"))
            sizes = held.groupBy("gene").agg(F.sum(length).alias("bytes"))
            kept_bits, _ = screen.screened(self.spark, x, people, found, members, sizes, subsets, pairs, s.method, options, self.lines)
            kept_bits = stored(kept_bits.select("feature_id"), "screened")
            x, members = x.join(kept_bits, "feature_id", "left_semi"), members.join(kept_bits, "feature_id", "left_semi")
        if folds is None and s.min_groups >= 0:
            models, kept = fit.fit_sequential(self.spark, x, people, members, pairs, s.min_groups, s.method, options)
        else:
            models, kept = fit.fit_grid(self.spark, x, people, members, pairs, s.method, options, folds), [(i, False) for i in range(len(pairs))]
        table = self.spark.createDataFrame(kept, "grid_ord int, below_min_groups boolean")
        out = self.counted("fit", "models", models.join(F.broadcast(table), "grid_ord").join(found.select("feature_id", "gene", "pos", "allele"), "feature_id", "left"))
        self.seconds["fit"] = time.perf_counter() - began
        return out

    def counted(self, phase: str, name: str, df: DataFrame) -> DataFrame:
        """df as a table, its rows noted."""
        seen = Observation()
        out = stored(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
        self.rows.append((phase, name, seen.get.get("n", 0)))
        return out

    def analysed(self, models: DataFrame) -> dict[str, DataFrame]:
        """scores() as tables, so that the time and rows of the analysis are those of its whole work."""
        began = time.perf_counter()
        tables = {name: self.counted("analysis", name, t) for name, t in self.scores(models).items()}
        self.seconds["analysis"] = time.perf_counter() - began
        return tables

    def phases(self) -> DataFrame:
        """phase, table, rows, seconds (of the phase) of what the run has written so far."""
        known = [(phase, name, n, self.seconds.get(phase)) for phase, name, n in self.rows]
        return self.spark.createDataFrame(known, "phase string, table string, rows long, seconds double")

    def scores(self, models: DataFrame) -> dict[str, DataFrame]:
        """Long tables over all models: pss, gss, hss, sps, gsc and evaluation, and the summaries of those models that pass the quality
        cutoffs. Settings.stats picks tables by letter (all by default); with summary_only there are summaries and evaluation only."""
        began = time.perf_counter()
        model = ["fold", "grid_ord"]
        bits = models.where("feature_id IS NOT NULL")
        pss = bits.groupBy(*model, "gene", "pos").agg(F.sum(F.abs("beta")).alias("pss"))
        gss = bits.groupBy(*model, "gene").agg(F.sum(F.abs("beta")).alias("gss"))
        weights = bits.groupBy("gene", "pos", "allele").agg(F.collect_list(F.struct(*model, "beta")).alias("weights"))
        if self.numbers is None:
            carried = encode.hits(self.sequences, weights, "weights", self.settings.data_type, self.salts()).select("seq_id", "gene", F.lit(1.0).alias("value"), F.inline("weights"))
        else:
            carried = encode.numeric_values(self.numbers, weights, "weights").select("seq_id", "gene", "value", F.inline("weights"))
        gsc = carried.groupBy(*model, "seq_id", "gene").agg(F.sum(F.col("value") * F.col("beta")).alias("contribution"))
        shifts = F.broadcast(models.select(*model, "intercept").distinct())  # one row a model
        every = self.people.select("seq_id", F.col("trait").alias("response")).join(shifts)
        totals = gsc.groupBy(*model, "seq_id").agg(F.sum("contribution").alias("_sum"))
        sps = every.join(totals, [*model, "seq_id"], "left").select(*model, "seq_id", "response", (F.coalesce("_sum", F.lit(0.0)) + F.col("intercept")).alias("sps"))
        sps = stored(sps, "sps")  # a row a sample and model; the evaluation and all summaries read it
        quality = sps.groupBy(*model).agg(F.avg((F.signum("sps") == F.signum("response")).cast("double")).alias("accuracy"), F.sqrt(F.avg(F.pow(F.col("response") - F.col("sps"), F.lit(2.0)))).alias("rmse"))
        passed = score.passing_models(quality, self.settings.rmse_cutoff, self.settings.accuracy_cutoff)
        tables = {"pss": pss, "gss": gss, "hss": gss.groupBy(*model).agg(F.sum("gss").alias("hss")), "gsc": gsc, "sps": sps}
        letters = self.settings.stats or "".join(score.STATISTICS)
        short = score.summaries({k: t.join(passed.select(*model), model) for k, t in tables.items()}, letters)
        asked = {} if self.settings.summary_only else {score.STATISTICS[k][0]: tables[score.STATISTICS[k][0]] for k in letters}
        self.seconds["analysis"] = time.perf_counter() - began
        return asked | {"evaluation": passed} | short


def predict(sequences: DataFrame, model: DataFrame, intercept: float, groups_of: DataFrame | None = None, response: DataFrame | None = None, data_type: str = "universal", salts: int = 1) -> tuple[DataFrame, DataFrame]:
    """Scores of new sequences (seq_id, response, sps) and their contributions (seq_id, group, contribution). With a response table
    only its sequences with a response stay. Genes of the model that the input lacks are an error. data_type is that of the training; salts: the
    groups that a gene's sequences are dealt to."""
    score.check_genes(model, sequences)
    by_gene = score.contributions(sequences, model, data_type, salts)
    names = model.select("gene").distinct().select("gene", F.col("gene").alias("group")) if groups_of is None else groups_of
    by_group = score.group_contributions(by_gene, names)
    people = sequences.select("seq_id").distinct()
    people = people.withColumn("response", F.lit(None).cast("double")) if response is None else people.join(response.select("seq_id", F.col("trait").alias("response")), "seq_id").where("response IS NOT NULL")
    return score.species_scores(people, by_group, intercept), by_group


def contribution_grid(scores: DataFrame, by_group: DataFrame, settings: Settings) -> DataFrame:
    """The cells of a contribution grid, or of an M-grid if the settings give its size."""
    people = score.normalized_probabilities(scores)
    long = by_group.withColumnRenamed("group", "field").join(people.select("seq_id", "response"), "seq_id")
    m = settings.m_grid
    fields = view.top_fields(view.column_scores(long), m[1] if m else settings.gene_limit, "afgsc" if m else "ssq", 0.0 if m else settings.gene_cutoff)
    return view.grid_cells(long, view.ordered_rows(people, m[0] if m else settings.species_limit, bool(m)), fields)
