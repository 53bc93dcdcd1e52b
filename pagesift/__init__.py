"""pagesift: ranking, de-duplication and filtering of web pages as Spark DataFrame operators."""
