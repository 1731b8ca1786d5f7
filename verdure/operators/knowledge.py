"""Small dimensions: classes, management knowledge, model registry. Their sizes are fixed, so they are broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import pretty

#: Fixed values: (class, disease, kind of pathogen, category of control).
CLASSES = (
    ("Tomato___Bacterial_spot", "Bacterial Spot", "bacterial", "chemical_may_be_needed"),
    ("Tomato___Early_blight", "Early Blight", "fungal", "chemical_may_be_needed"),
    ("Tomato___Late_blight", "Late Blight", "fungal", "chemical_may_be_needed"),
    ("Tomato___Leaf_Mold", "Leaf Mold", "fungal", "chemical_may_be_needed"),
    ("Tomato___Septoria_leaf_spot", "Septoria Leaf Spot", "fungal", "chemical_may_be_needed"),
    ("Tomato___Spider_mites Two-spotted_spider_mite", "Two-Spotted Spider Mite Infestation", "pest", "biological_available"),
    ("Tomato___Target_Spot", "Target Spot", "fungal", "chemical_may_be_needed"),
    ("Tomato___Tomato_Yellow_Leaf_Curl_Virus", "Tomato Yellow Leaf Curl Virus (TYLCV)", "viral", "vector_control_for_viral"),
    ("Tomato___Tomato_mosaic_virus", "Tomato Mosaic Virus (ToMV)", "viral", "vector_control_for_viral"),
    ("Tomato___healthy", "Healthy Plant", "none", "none_healthy"),
)
#: Fixed values: (model, kind), in order of preference.
MODELS = (("Hybrid_CNN_ViT", "proposed"), ("EfficientNetB7", "baseline"), ("VGG16", "baseline"), ("RegNetY008", "baseline"), ("CNN_Only", "baseline"), ("NaiveConcat_CNN_ViT", "ablation"), ("ViT_Branch", "ablation"), ("Hybrid_CNN_ViT_noCAMreg", "ablation"))
#: Advice by category of control, in our own words.
ADVICE = {
    "chemical_may_be_needed": ["Take off the worst leaves and keep foliage dry.", "If spots keep spreading, ask an adviser about a registered product."],
    "biological_available": ["Release predatory mites and rinse leaf undersides."],
    "vector_control_for_viral": ["Pull infected plants and control the insects that carry the virus."],
    "none_healthy": ["Nothing to treat: keep watching weekly."],
}

#: What every advice ends with, in our own words.
DISCLAIMER = "This advice comes from an automatic reading of one leaf photo. It supports a decision and replaces neither a local agronomist nor the label of a product."
#: What is seen, by class, in our own words.
SYMPTOMS = (
    "Small dark spots with a wet edge on leaves and fruit.", "Brown spots with rings, first on old leaves.", "Large grey-green wet patches that turn brown, pale mould below.", "Yellow patches above, olive mould below.",
    "Many small round spots with pale centres.", "Fine pale stippling, later webs below the leaf.", "Brown spots with faint rings on leaves and fruit.", "Leaves curl up, turn yellow at the edges and stay small.",
    "Light and dark green mosaic, leaves narrow and bent.", "Even green leaves without spots.",
)
#: Fields of management by kind of pathogen, in our own words: practices, sanitation, irrigation, monitoring, prevention.
MANAGEMENT = {
    "bacterial": ("Work in dry plants only.", "Clean tools between rows and take infected leaves away.", "Water the soil, not the leaves.", "Look at the youngest leaves after rain.", "Use tested seed and rotate for two years."),
    "fungal": ("Prune low leaves and space plants for air.", "Remove fallen and infected leaves from the field.", "Water early in the day, at the roots.", "Look at the oldest leaves twice a week.", "Rotate away from tomato, potato and pepper."),
    "pest": ("Keep beneficial insects and avoid broad insecticides.", "Remove the worst infested leaves and weeds.", "Keep plants well watered in hot dry spells.", "Look below leaves with a lens every week.", "Check seedlings before planting."),
    "viral": ("Pull infected plants early.", "Wash hands and tools, keep tobacco away.", "Water evenly, so plants are not stressed.", "Watch for the insects that carry the virus.", "Plant resistant varieties under nets."),
    "none": ("Go on as before.", "Keep beds free of old leaves.", "Water evenly at the roots.", "Look at the plants every week.", "Rotate crops and use clean seed."),
}
FIELDS = ("cultural_practices", "sanitation", "irrigation", "monitoring", "prevention")


def diseases(index: DataFrame) -> DataFrame:
    """A row for each class of `index` (class_id, n), in the order of the index: id, name and the fields of its advice; those of a class that isn't known are null."""
    rows = [(i, x[0], *x[1:], SYMPTOMS[i], *MANAGEMENT[x[2]]) for i, x in enumerate(CLASSES)]
    known = index.sparkSession.createDataFrame(rows, "class_id int, id string, disease_name string, pathogen_type string, control_category string, symptoms string, " + ", ".join(f"{f} string" for f in FIELDS))
    out = index.join(F.broadcast(known), "class_id", "left")
    name = F.coalesce("id", F.concat(F.lit("class_"), F.col("class_id").cast("string")))
    return out.withColumn("id", name).withColumn("name", pretty("id")).withColumn("disclaimer", F.lit(DISCLAIMER)).orderBy("class_id")


#: The model shown first, and how the gate's mode is told.
DEFAULT_MODEL = "Hybrid_CNN_ViT"


def status(files: DataFrame, thresholds, ood: bool) -> DataFrame:
    """One row on what is installed. files: (model, temperature or null), a row for each installed model."""
    known = models(files.sparkSession)
    out = files.join(F.broadcast(known), "model", "left").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("ord", F.lit(len(MODELS))).alias("ord"), "model"))).alias("m"), F.array_sort(F.collect_set(F.when(F.col("temperature").isNotNull(), F.col("model")))).alias("calibrated_models"))
    names = F.transform("m", lambda x: x["model"])
    mode = f"heuristic + deep tomato-identity ({', '.join(sorted(thresholds))})" if thresholds else "heuristic stages only"
    out = out.select(names.alias("models"), "calibrated_models", F.lit(mode).alias("gate_mode"), F.lit(ood).alias("feature_ood"))
    default = F.when(F.array_contains("models", DEFAULT_MODEL), DEFAULT_MODEL).otherwise(F.get(F.col("models"), F.lit(0)))
    return out.withColumn("default_model", default).withColumn("status", F.when(F.size("models") > 0, "ok").otherwise("models_missing"))


def classes(spark: SparkSession) -> DataFrame:
    """class_id (from 0), class, disease_name, pathogen_type, control_category, advice: ten rows."""
    rows = [(i, *x, ADVICE[x[3]]) for i, x in enumerate(CLASSES)]
    return spark.createDataFrame(rows, "class_id int, class string, disease_name string, pathogen_type string, control_category string, advice array<string>")


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *x) for i, x in enumerate(MODELS)], "ord int, model string, kind string")


def with_advice(predictions: DataFrame, on: str = "class_id") -> DataFrame:
    """Inner join: every class has a row of knowledge, an unknown class is an error."""
    known = F.assert_true((F.col(on) >= 0) & (F.col(on) < len(CLASSES)), F.lit("unknown class"))
    return predictions.filter(known.isNull()).join(F.broadcast(classes(predictions.sparkSession)), on)


def registry(manifest: DataFrame) -> DataFrame:
    """Models in registry order, then the manifest's other models by name. manifest: (model, trunk_mb, head_mb)."""
    known = models(manifest.sparkSession)
    listed = known.join(manifest, "model", "left").withColumn("listed", F.lit(True))
    others = manifest.join(F.broadcast(known), "model", "left_anti").select("model", F.lit(None).cast("int").alias("ord"), F.lit("other").alias("kind"), "trunk_mb", "head_mb", F.lit(False).alias("listed"))
    size = F.nullif(F.coalesce("trunk_mb", F.lit(0.0)) + F.coalesce("head_mb", F.lit(0.0)), F.lit(0.0))
    return listed.unionByName(others).select("model", "ord", "kind", "listed", size.alias("size_mb"))
