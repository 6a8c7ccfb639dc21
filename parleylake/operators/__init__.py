"""parleylake.operators"""
