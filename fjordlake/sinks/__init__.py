"""Writers of documents, features and metadata."""
