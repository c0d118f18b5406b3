"""Part of quillmere."""
