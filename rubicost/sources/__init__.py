"""Reading and writing of files and cell values."""
