"""Feature extraction as one call: items and image files in; vectors, a summary, errors and a report out. It goes on where it stopped."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import images as I
from ..functions import text as T
from ..sources import sinks
from ..sources.items import from_metadata, read_images, read_metadata
from .matching import with_text_vectors
from .tfidf import TfIdf


@dataclass
class FeatureExtraction:
    """``metadata`` is a JSON array of items; an item's image is ``images``/category/filename. Results go below ``out``.

    ``out``/features has a row per item and attempt, in a folder per attempt; ``out``/summary, ``out``/errors and ``out``/report
    are of all items, ``out``/vectorizer is fitted on the labelled descriptions by the first run.
    """

    metadata: str
    images: str
    out: str
    include_sift: bool = False
    vectorizer: TfIdf = field(default_factory=TfIdf)

    def _attempts(self, spark: SparkSession) -> list[str]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.out}/features")
        files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        return sorted(f.getPath().getName() for f in files.listStatus(path) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))) if files.exists(path) else []

    def features(self, spark: SparkSession) -> DataFrame:
        """Each item's last attempt."""
        done = spark.read.option("basePath", f"{self.out}/features").parquet(*(f"{self.out}/features/{a}" for a in self._attempts(spark)))
        last = Window.partitionBy("id").orderBy(F.desc("attempt"))
        return done.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", "attempt")

    def run(self, spark: SparkSession) -> list[str]:
        """The report's lines. Items that have vectors already are left as they are; those with an error are tried again."""
        items = from_metadata(read_metadata(spark, self.metadata))
        attempts = self._attempts(spark)
        if attempts:
            fitted = TfIdf.load(spark, f"{self.out}/vectorizer")
            ready = self.features(spark).where("error IS NULL").select("id")
            items = items.join(ready, "id", "left_anti")
        else:
            fitted = self.vectorizer.fit(items.where("labelled AND description IS NOT NULL").select("id", "description"))
            fitted.save(f"{self.out}/vectorizer")
        # Matched by the last two parts of the path, as they are in the file system's own spelling of the folder.
        name = F.concat_ws("/", F.slice(F.split(F.url_decode("image.origin"), "/"), -2, 2))
        pictures = read_images(spark, f"{self.images}/*/*").select(name.alias("name"), "image")
        asked = items.withColumn("name", F.concat_ws("/", "category", "filename")).join(pictures, "name", "left").drop("name")
        made = asked.withColumn("made", I.image_result("image", self.include_sift)).drop("image")
        rows = made.withColumns({"image": F.col("made.vector"), "error": F.col("made.error"), "has_description": F.col("description").isNotNull()}).drop("made")
        rows = with_text_vectors(rows, fitted).withColumns({
            "image_feature_dims": F.when(F.col("image").isNotNull(), I.dims(self.include_sift)),
            "text_feature_dims": F.create_map(F.lit("text_stats"), F.lit(8), F.lit("keywords"), F.lit(18), F.lit("tfidf"), F.lit(fitted.max_features)),
            "extracted_keywords": T.keyword_sets(F.col("description")),
        })
        rows.write.mode("overwrite").parquet(f"{self.out}/features/attempt={len(attempts):06d}")
        features = self.features(spark)
        sinks.save_csv(sinks.feature_summary(features), f"{self.out}/summary")
        sinks.save_json(sinks.dead_letters(features), f"{self.out}/errors")
        report = sinks.extraction_report(features)
        sinks.save_lines(spark, report, f"{self.out}/report")
        return report
