"""Reading and writing of layouts."""
