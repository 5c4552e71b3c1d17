"""Schemas of stored and exchanged rows; readers never infer them."""

DEFINITION_FILE = """
    description string,
    tables array<struct<
        name: string, description: string, match_strategy: string, min_elements: int,
        min_percentage: double, min_score: double,
        text_elements: array<struct<
            search_text: string, max_errors: int, max_error_rate: double,
            match_case: boolean, weight: double, description: string>>>>
"""

# One row per table, as the rows of a definition file come out.
DEFINITION_ROW = """
    table_idx int, name string, match_strategy string, min_elements int, min_percentage double, min_score double,
    description string, text_elements array<struct<
        search_text: string, max_errors: int, max_error_rate: double, match_case: boolean, weight: double, description: string>>
"""

DETECTION = """
    table_name string, document_name string, file_path string, found boolean,
    pages_found array<int>, confidence_score double, match_details string
"""

# ``since``: the first ``seq`` whose pages belong to the document as it is now.
DOCUMENT_LOG = """
    doc_id string, file_name string, file_path string, page_count int, file_size bigint,
    file_hash string, last_modified double, processing_date timestamp,
    has_digital boolean, has_ocr boolean, since bigint, writer string, batch bigint, seq bigint
"""

PAGE_LOG = "doc_id string, page int, digital string, ocr string, writer string, batch bigint, seq bigint"

RUN_LOG = """
    file_name string, file_hash string, success boolean, pages_processed int, error string,
    writer string, batch bigint, seq bigint
"""

# One row per page, so that a document may have any number of them; a document without pages has one row, its page null.
# A channel that is null was not extracted, one that is "" was and is empty.
EXTRACT = """
    doc_id string, file_name string, file_path string, file_size bigint, file_hash string,
    last_modified double, page int, digital string, ocr string
"""
