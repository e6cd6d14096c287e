"""Reading and writing: metadata JSON, lookup tables, files, chunked grids."""
