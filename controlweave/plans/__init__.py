"""Control specifications and the DataFrame plans made from them."""
