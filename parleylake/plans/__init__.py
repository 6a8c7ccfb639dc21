"""parleylake.plans"""
