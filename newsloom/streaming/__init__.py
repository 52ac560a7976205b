"""The batch operators on streams of landed documents, responses and fetch logs."""
