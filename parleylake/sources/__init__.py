"""parleylake.sources"""
