"""Outcomes as rows: job_id, doc_id, success, message, outputs. Where a request would fail, a row fails."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What each operation says, and what is said of errors.
DONE = {
    "merge": "PDFs merged successfully", "extract": "Pages extracted successfully", "remove": "Pages removed successfully", "stamp": "Watermark added successfully",
    "text": "Text added successfully", "signature": "Signature added successfully", "cover": "Content redacted successfully",
    "markdown": "PDF converted to Markdown", "docx": "PDF converted to DOCX",
}
FAILED = {
    "merge": "Failed to merge PDFs", "split": "Failed to split PDF", "extract": "Failed to extract pages", "remove": "Failed to remove pages", "stamp": "Failed to add watermark",
    "text": "Failed to add text", "signature": "Failed to add signature", "cover": "Failed to redact content",
    "markdown": "Failed to convert to Markdown", "docx": "Failed to convert to DOCX", "info": "Failed to get PDF info", "download": "Failed to download file",
}
TOO_LARGE = "File size exceeds maximum allowed size of 100MB. Please upload a smaller file."
BAD_UPLOAD = "Error processing file upload. Please ensure you're uploading valid PDF files."
MISSING = "Missing required parameter: "
BAD_INPUT = "Invalid input: "
UNEXPECTED = "An unexpected error occurred while processing your request. Please try again."
MOST_BYTES = 100 * 1024 * 1024


def outcome(kind: Column, detail: Column) -> Column:
    """struct(status, success, message) of an outcome: done, failed, too_large, bad_upload, missing, bad_input, or anything
    else, which is unexpected. detail: what a message has to say besides."""

    def one(status: int, message: Column) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(status == 200).alias("success"), message.alias("message"))

    return (
        F.when(kind == "done", one(200, detail)).when(kind == "failed", one(400, detail)).when(kind == "too_large", one(413, F.lit(TOO_LARGE)))
        .when(kind == "bad_upload", one(400, F.lit(BAD_UPLOAD))).when(kind == "missing", one(400, F.concat(F.lit(MISSING), detail)))
        .when(kind == "bad_input", one(400, F.concat(F.lit(BAD_INPUT), detail))).otherwise(one(500, F.lit(UNEXPECTED)))
    )


def results(df: DataFrame, operation: str, ok: Column, cause: Column, outputs: Column, strict: bool = False) -> DataFrame:
    """df with job_id and doc_id to results; strict: the first row that fails ends the job."""
    said = F.concat(F.lit(f"{FAILED[operation]}: "), cause)
    message = F.when(ok, F.lit(DONE[operation])).otherwise(F.raise_error(said) if strict else said)
    return df.select("job_id", "doc_id", ok.alias("success"), message.alias("message"), F.when(ok, outputs).otherwise(F.array().cast("array<string>")).alias("outputs"))
