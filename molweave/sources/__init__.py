"""Reading corpora and writing the small tables made from them."""
