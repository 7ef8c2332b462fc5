"""sqlkiln: Spark-native data jobs around natural-language-to-SQL work.

Every public function takes DataFrames (or a SparkSession and a table
directory) and returns a DataFrame; nothing is collected to the driver.
"""

__version__ = "0.1.0"
