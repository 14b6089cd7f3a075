"""The four reports and the views over them."""
