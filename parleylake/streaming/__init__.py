"""parleylake.streaming"""
